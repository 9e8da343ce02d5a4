"""Models reach workers that can't import the package: broadcasts are pickled by reference."""

import io
import pickle

import numpy as np
import pytest

from renewlake.llm import multi_index, quality, toxicity


@pytest.fixture
def index():
    v = np.random.default_rng(3).standard_normal((60, 8))
    return multi_index.MultiIndex(v / np.linalg.norm(v, axis=1, keepdims=True), 60, 0.9, 0.995, 5)


def named_classes(value):
    """Modules that unpickling the value imports."""
    found = []

    class Reader(pickle.Unpickler):
        def find_class(self, module, name):
            found.append(module)
            return super().find_class(module, name)

    Reader(io.BytesIO(pickle.dumps(value))).load()
    return {m.split(".")[0] for m in found}


def test_broadcast_values_name_no_class_of_the_package(index):
    s = quality.Settings()
    model = quality.Model(s, np.zeros((2, 2)), np.zeros(1), np.ones(1), (np.zeros(1),), 1.0)
    toxic = toxicity.Model({"bad": (2.0, 3.0)}, -0.3, 1.0, 0.0, 0.01)
    for value in (model.plain(), vars(toxic), vars(index)):
        assert named_classes(value) <= {"numpy"}
    assert toxicity.Model(**vars(toxic)) == toxic
    again = multi_index.MultiIndex.of(vars(index))
    assert (again.home(np.eye(8))[0] == index.home(np.eye(8))[0]).all()
    assert quality.Settings(**model.plain()["settings"]) == s


def test_pooling_does_not_depend_on_blocks(monkeypatch):
    rnd = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in rnd.integers(0, 50, n)) for n in (0, 3, 700, 1, 90)] + [None, ""]
    s = quality.Settings(buckets=64, size=4)
    contexts = rnd.standard_normal((64, 4)).astype(np.float32)
    want = quality.pooled(quality.Indexer(s), contexts, texts)
    monkeypatch.setattr(quality, "BLOCK_WORDS", 7)
    monkeypatch.setattr(quality, "BLOCK_CHARS", 40)
    assert np.allclose(quality.pooled(quality.Indexer(s), contexts, texts), want, atol=1e-6)
    assert (want[[0, 5, 6]] == 0).all()


def test_context_sums_do_not_depend_on_blocks(table, monkeypatch):
    rnd = np.random.default_rng(5)
    docs = table([(i, " ".join(f"w{w}" for w in rnd.integers(0, 30, 60))) for i in range(8)] + [(9, None), (10, "one")])
    s = quality.Settings(buckets=64, size=4)
    want = quality.context_vectors(docs, s)
    monkeypatch.setattr(quality, "BLOCK_WORDS", 5)
    assert want.any() and (quality.context_vectors(docs, s) == want).all()


def test_long_words_keep_their_whole_shape():
    assert quality.word_shape("Ab1" * 40 + "!!") != quality.word_shape("Ab1" * 40)
