"""Secrets to their end, and names without a title."""

import base64
import random
import re

from renewlake.llm import pii


def spans(text):
    return [(text[a:b], kind) for a, b, kind, _ in pii.find_entities(text, pii._compiled())]


def test_secrets_to_their_end(table):
    rnd = random.Random(5)
    long = base64.b64encode(rnd.randbytes(222)).decode()
    jwt = ".".join(base64.urlsafe_b64encode(rnd.randbytes(n)).decode().rstrip("=") for n in (30, 200, 32))
    huge = "".join(rnd.choice("0123456789abcdef") for _ in range(200_000))
    assert len(long) > 290 and spans(f'token = "{long}" end') == [(long, "secret")]
    assert spans(f"api_key: {jwt}.") == [(jwt, "secret")]  # the full stop ends the sentence
    assert spans("password=plain-enough, or token=ab") == [("plain-enough", "secret")]
    texts = [f'token = "{long}" end', f"api_key: {jwt}.", f"secret={huge}"]
    got = {r.doc_id: r.text for r in pii.replace_pii(table(list(enumerate(texts))), b"key").collect()}
    for i, secret in enumerate((long, jwt, huge)):
        shown = re.search(r"[A-Za-z0-9_+/=.~-]{60,}", got[i].removeprefix("secret="))[0].rstrip(".")
        assert len(shown) == len(secret) and not any(secret[k: k + 12] in got[i] for k in range(0, len(secret) - 12, 7))
    assert re.fullmatch(r"secret=[0-9a-f]+", got[2])


def test_names_without_a_title(table):
    texts = ["SMITH called. Mr. John Smith came; John sat, and Smith said: Smith's hat, Smithson's coat.",
             "Smith and John without a title", "Mr. Dr Weber and another Dr Braun", "господин Петров, потом Петров"]
    got = {r.doc_id: r.text for r in pii.replace_pii(table(list(enumerate(texts))), b"key").collect()}
    first, last = re.search(r"Mr\. (\w+) (\w+) came", got[0]).groups()
    assert got[0] == (f"{last.upper()} called. Mr. {first} {last} came; {first} sat, and {last} said: "
                      f"{last}'s hat, Smithson's coat.")
    assert {first, last}.isdisjoint({"John", "Smith"}) and got[1] == texts[1]
    assert "another Dr" in got[2] and "Weber" not in got[2] and "Braun" not in got[2]
    assert re.fullmatch(r"господин ([А-Я][а-я]+), потом \1", got[3])


def test_addresses_grow_after_collisions():
    late = [pii.surrogate(b"key", "ipv4", "1.2.3.4", pii.PLAIN_ROUNDS + k) for k in range(1, 400)]
    assert len(set(late)) == 399 and len({tuple(map(len, a.split("."))) for a in late}) > 5
    assert all(spans(a) == [(a, "ipv4")] for a in late)
    early = [pii.surrogate(b"key", "ipv4", "1.2.3.4", k) for k in range(pii.PLAIN_ROUNDS + 1)]
    assert all(len(a) == 7 for a in early)
