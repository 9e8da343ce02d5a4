"""Main text of web pages by site style trees: what a host's pages share is not their text."""

from __future__ import annotations

import math

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from renewlake.llm.common import prepared, shuffle_parts, stored
from renewlake.llm.page_blocks import Elements, Page

LEAST_IMPORTANCE = 0.3  # branches and texts below it go
LEAST_PAGES = 3  # different pages of a host, before what they share counts against it
DECAY = 0.9  # how fast the variants of an element's children take weight from their content
BROADCAST_LOW = 500_000  # paths and texts of 8 bytes

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _signed(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def text_key(path: int, text: str) -> int:
    """A text as a content node of the tree: what it says and where."""
    return _signed(path.to_bytes(8, "little") + text.encode())


def _nodes(batches):
    """The style tree of each page: its elements with the order of their children, and its texts."""
    known = Elements()
    for batch in batches:
        rows = {name: [] for name in NODE_NAMES}

        def put(*values):
            for name, value in zip(NODE_NAMES, values):
                rows[name].append(value)

        for host, html in zip(*[c.to_pylist() for c in batch.columns]):
            page = Page(html, known)
            digest = _signed("\x00".join(f"{b.path}\x01{b.text}" for b in page.blocks).encode())
            holds = {b.path: b for b in page.blocks}
            for path, labels in page.children.items():
                block = holds.get(path)
                put(host, digest, path, page.above(path), 0, _signed("\x00".join(labels).encode()), 0, 0,
                    bool(block and block.dropped), bool(block and block.article))
            texts = {}
            for b in page.blocks:
                size = texts.setdefault((b.path, b.text), [0, 0])
                size[0] += len("".join(b.text.split()))
                size[1] += b.linked
            for (path, text), (chars, linked) in texts.items():
                put(host, digest, path, page.above(path), 1, text_key(path, text), chars, linked, False, False)
        yield pa.RecordBatch.from_pydict(rows, schema=NODE_ARROW)


NODE_ARROW = pa.schema([
    ("host", pa.string()), ("digest", pa.int64()), ("path", pa.int64()), ("above", pa.list_(pa.int64())),
    ("kind", pa.int32()), ("feature", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()),
    ("dropped", pa.bool_()), ("article", pa.bool_())])
NODE_NAMES = NODE_ARROW.names
NODE_SCHEMA = ("host string, digest long, path long, above array<long>, kind int, feature long, chars long, linked long, "
               "dropped boolean, article boolean")


def site_nodes(pages: DataFrame) -> DataFrame:
    """Style nodes (kind 0) and content nodes (kind 1) of every host, with the number of its pages that have them.

    `pages` has host and html. Pages of one host with the same blocks count once.
    """
    found = pages.mapInArrow(_nodes, NODE_SCHEMA).distinct()
    return found.groupBy("host", "path", "above", "kind", "feature").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.max("dropped").alias("dropped"), F.max("article").alias("article"))


def _entropy_share(m, weighted):
    """Entropy of shares c / m over its most, ln m, given the sum of c ln c; of one page it is 1."""
    return F.when(m <= 1, 1.0).otherwise(1 - weighted / (m * F.log(m)))


def element_importance(nodes: DataFrame) -> DataFrame:
    """(host, path, above, m, importance, ...) of every element, by itself and not yet by what it holds.

    m counts the pages that have the element; `style` is the entropy of its variants of
    children, `content` one less the mean entropy of its texts (a text on all m pages has
    the most, ln m, one on a single page none), `variants` and `texts` their numbers.
    """
    c = F.col("pages").cast("double")
    of_style, of_text = F.col("kind") == 0, F.col("kind") == 1
    sums = nodes.groupBy("host", "path", "above").agg(
        F.sum(F.when(of_style, F.col("pages"))).alias("m"),
        F.sum(F.when(of_style, c * F.log(c))).alias("styles"),
        F.count(F.when(of_style, 1)).alias("variants"),
        F.sum(F.when(of_text, F.log(c)).otherwise(0.0)).alias("repeats"),
        F.count(F.when(of_text, 1)).alias("texts"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.max("dropped").alias("dropped"), F.max("article").alias("article"))
    m = F.col("m")
    return sums.withColumn("style", _entropy_share(m, F.col("styles"))).withColumn(
        "content", F.when(F.col("texts") == 0, 0.0).when(m < LEAST_PAGES, 1.0).otherwise(
            1 - F.col("repeats") / (F.col("texts") * F.log(m))))


def branch_importance(elements: DataFrame) -> DataFrame:
    """(host, branch, m, importance) of every element with all that it holds.

    The texts below an element, each element with the pages it is on, give the content; of
    its own variants of children l there are, (1 - DECAY^l) is the weight of their entropy.
    What is mostly links counts little.
    """
    held = elements.where("texts > 0").select("host", F.explode("above").alias("branch"), "m", "content", "chars", "linked")
    below = held.groupBy("host", "branch").agg(
        (F.sum(F.col("m") * F.col("content")) / F.sum("m")).alias("held"),
        (F.sum("linked") / F.sum("chars")).alias("links"))
    own = elements.select("host", F.col("path").alias("branch"), "m", "style", "variants")
    weight = F.pow(F.lit(DECAY), F.col("variants"))
    value = F.when(F.col("m") < LEAST_PAGES, F.col("held")).otherwise((1 - weight) * F.col("style") + weight * F.col("held"))
    return own.join(below, ["host", "branch"]).select("host", "branch", "m", (value * (1 - F.col("links"))).alias("importance"))


def low_branches(nodes: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, keys): paths of elements and keys of texts that do not belong to the main text of a host's pages.

    An element goes that lies in a branch of low importance, itself included, or whose role
    is known (menus, footers, adverts, forms, comments, ...: importance 0); a text goes that
    nearly all of the element's pages have. What an article holds stays unless its role says
    otherwise, whatever a host repeats.
    """
    elements = stored(element_importance(nodes), "site-elements")
    texts = elements.where("texts > 0")
    low = branch_importance(elements).where(F.col("importance") < least).select("host", "branch")
    inside = texts.where("not dropped and not article").select("host", "path", F.explode("above").alias("branch"))
    by_branch = inside.join(low, ["host", "branch"], "left_semi").select("host", F.col("path").alias("key")).distinct()
    by_role = texts.where("dropped").select("host", F.col("path").alias("key"))
    common = nodes.where("kind = 1 and pages >= 2").select("host", "path", "feature", "pages").join(
        texts.where((F.col("m") >= LEAST_PAGES) & ~F.col("dropped") & ~F.col("article")).select("host", "path", "m"),
        ["host", "path"])
    share = 1 - F.log(F.col("pages").cast("double")) / F.log(F.col("m").cast("double"))
    by_text = common.where(share < least).select("host", F.col("feature").alias("key"))
    return by_branch.unionAll(by_role).unionAll(by_text).groupBy("host").agg(F.collect_set("key").alias("keys"))


def _main_text(batches):
    known = Elements()
    for batch in batches:
        ids, urls, pages, lows = (c.to_pylist() for c in batch.columns)
        texts, blocks = [], []
        for html, low in zip(pages, lows):
            page, low = Page(html, known), set(low or ())
            kept = [b for b in page.blocks if b.path not in low and text_key(b.path, b.text) not in low]
            if any(b.article for b in kept):
                kept = [b for b in kept if b.article]
            texts.append(" ".join(b.text for b in kept))
            blocks.append(len(kept))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()),
             pa.array(blocks, pa.int64())], names=["page_id", "url", "text", "n_blocks"])


def _with_lows(pages: DataFrame, lows: DataFrame) -> DataFrame:
    """Pages with the keys of their host. A host with more than its share of pages is split over several tasks."""
    total = lows.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    if total <= BROADCAST_LOW:
        return pages.join(F.broadcast(lows), "host", "left")
    parts = shuffle_parts(pages.sparkSession)
    share = max(1, math.ceil(pages.count() / parts))
    hot = stored(pages.groupBy("host").count().where(F.col("count") > share).select(
        "host", F.ceil(F.col("count") / share).cast("int").alias("splits")), "hot-hosts")  # at most `parts` rows
    one = F.coalesce("splits", F.lit(1))
    of_page = pages.join(F.broadcast(hot), "host", "left").withColumn(
        "split", F.pmod(F.xxhash64("page_id", "html"), one).cast("int")).drop("splits")
    of_host = lows.join(F.broadcast(hot), "host", "left").select(
        "host", "keys", F.explode(F.sequence(F.lit(0), one - 1)).alias("split"))
    return of_page.join(of_host, ["host", "split"], "left")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_blocks), one row per input row: the main text of every page.

    The pages of a host are merged into one style tree: elements by their way from the root
    (tag, class names, ids, roles; digits left out), with the variants of their children and
    their texts. An element's importance falls the more pages share its variants and its
    texts; branches of low importance go from each page. Of what is left, articles stay
    alone where a page has them. Blocks are joined by one space in page order, with character
    references decoded and white space made one space.

    Defined cases: a null or empty page, or one without main text, has the text ''; a page
    without a host in its url is a site of its own; a host with fewer than three different
    pages is judged by roles and links alone; rows that repeat a page_id are further pages;
    an empty table gives an empty table; further columns are ignored.
    """
    prepared(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), HOST, 1))
    html = F.col(html_col).cast("string")
    own = F.concat(F.lit("/"), F.coalesce(F.xxhash64(html), F.lit(0)).cast("string"))  # no host: a site of its own
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        html.alias("html"), F.when(host != "", host).otherwise(own).alias("host"))
    nodes = stored(site_nodes(rows.select("host", "html")), "site-nodes")
    lows = stored(low_branches(nodes), "site-lows")
    return _with_lows(rows, lows).select("page_id", "url", "html", "keys").mapInArrow(
        _main_text, "page_id long, url string, text string, n_blocks long")
