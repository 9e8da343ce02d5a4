"""Jaccard join on word n-grams with a token-group matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from renewlake.llm.common import prepared, stored, texts_of
from renewlake.llm.components import connected_components
from renewlake.llm.words import RunHashes, WordHashes

SKETCH_BITS = 18  # hash buckets of the word and token counts, which only order the tokens
SKETCH_ROW = 16  # buckets that share a row while they are summed
BLOCK_TOKENS = 500_000  # tokens that one block of a group, or of its queries, may hold
BROADCAST_DOCS = 100_000


def _sets(size: int, hashes: WordHashes, texts):
    """Of each text: word hashes, sorted distinct shingle hashes, and a place where each shingle occurs."""
    for text in texts:
        words = hashes.of((text or "").encode().lower().split())
        if not len(words):
            yield words, words, np.empty(0, np.int64)
            continue
        k = min(size, len(words))
        at = np.arange(len(words) - k + 1)
        yield words, *np.unique(RunHashes(words).of(at, at + k), return_index=True)


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Counts by hash bucket over all documents: of words, and of the documents that hold a token. 2 * 2^18 sums."""

    def run(batches):
        hashes, counts = WordHashes(), np.zeros((2, 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            found = [(w, t) for w, t, _ in _sets(size, hashes, batch.column(0).to_pylist())]
            for kind in range(2 if found else 0):
                counts[kind] += np.bincount(_bucket(np.concatenate([f[kind] for f in found])), minlength=counts.shape[1])
        rows = counts.reshape(-1, SKETCH_ROW)
        at = np.flatnonzero(rows.any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), *(pa.array(c) for c in rows[at].T)], names=["row", *columns])

    columns = [f"c{i}" for i in range(SKETCH_ROW)]
    parts = docs.select("text").mapInArrow(run, "row int, " + ", ".join(f"{c} long" for c in columns))
    found = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    counts = np.zeros(((2 << SKETCH_BITS) // SKETCH_ROW, SKETCH_ROW), np.int64)
    counts[found["row"].to_numpy()] = found[columns].to_numpy()
    return counts.reshape(2, -1)


class Rarity:
    """About how many documents hold a token: any fixed order is right, one with the rare first shuffles little.

    Words met independently would make a token as frequent as the product of their shares
    says; the count of the token's own bucket tells repeated passages, where it stands out.
    """

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.tokens = size, counts[1]
        self.words = np.log((counts[0] + 1) / max(1, counts[0].sum()))
        self.total = np.log(max(1, counts[1].sum()))
        self.noise = 2 * counts[1].mean() + 8

    def of(self, words: np.ndarray, tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
        share = np.concatenate([[0.0], np.cumsum(self.words[_bucket(words)])])
        ends = np.minimum(places + self.size, len(words))
        own = self.tokens[_bucket(tokens)]
        seen = np.where(own > self.noise, np.log(own + 1.0), 0.0)
        return np.round(np.maximum(share[ends] - share[places] + self.total, seen), 1)


def _bitmap(tokens: np.ndarray) -> bytes:
    """The set as bits, about one to two for each token: bit (token modulo width) says that some token falls there."""
    width = 1 << max(6, int(len(tokens) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap as it would be with fewer bits."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def _signatures(size: int, percent: int, counts):
    """Set size, set hash, bitmap and prefix of each document: its rarest tokens, one of which any partner shares."""

    def run(batches):
        hashes, order = WordHashes(), Rarity(counts.value, size)
        for batch in batches:
            ns, ones, twos, maps, prefixes = [], [], [], [], []
            for words, tokens, places in _sets(size, hashes, batch.column(2).to_pylist()):
                n = len(tokens)
                ns.append(n)
                both = RunHashes(tokens), RunHashes(tokens, 1)
                one, two = (r.of(np.array([0]), np.array([n])).view(np.int64)[0] for r in both)
                ones.append(one)
                twos.append(two)
                maps.append(_bitmap(tokens))
                least = -(-percent * n // 100)  # tokens a partner must share at least
                rare = np.lexsort((tokens, order.of(words, tokens, places)))[: n - least + 1] if n else []
                prefixes.append(tokens[rare].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int32()), pa.array(ones, pa.int64()),
                 pa.array(twos, pa.int64()), pa.array(maps, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "s1", "s2", "bits", "prefix"])

    return run


def _full_sets(size: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [t.tobytes() for _, t, _ in _sets(size, hashes, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "tokens"])

    return run


def _open_groups(percent: int):
    """Of one block of a group's members and of its queries: an edge for each query that links with a member.

    A query whose overlap with the union of the block's tokens is too small for any link is
    passed over; only then are the members compared one by one, until the first link.
    """

    def run(block: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, np.uint64) for t in block["tokens"]]
        reps, asks = block["rep"].tolist(), block["asks"].tolist()
        members = [i for i, ask in enumerate(asks) if not ask]
        found = []
        if members:
            union = np.unique(np.concatenate([sets[i] for i in members]))
            for q, ask in enumerate(asks):
                if not ask:
                    continue
                mine, n = sets[q], len(sets[q])
                at = np.minimum(np.searchsorted(union, mine), len(union) - 1)
                if 100 * int((union[at] == mine).sum()) < percent * n:
                    continue
                for m in members:
                    other = sets[m]
                    if reps[m] == reps[q] or 100 * min(n, len(other)) < percent * max(n, len(other)):
                        continue
                    at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                    same = int((other[at] == mine).sum())
                    if 100 * same >= percent * (n + len(other) - same):
                        found.append((reps[q], reps[m]))
                        break
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _enough(percent: int, least: Column, most: Column) -> Column:
    """Whether c shared prefix tokens allow a link of a set of n tokens with one of least to most tokens.

    Of two sets, take the one whose prefix ends first in the order: its prefix tokens that the
    other lacks in its own prefix it lacks altogether, so the overlap is at most the set's size
    less those. The overlap that a link needs bounds c from below; a link also bounds the sizes.
    Up to n tokens the bound rises with the other set's size. Beyond, it falls on average by
    `fall` a token, but ceilings lift it by up to one: the least lies within 1 / fall of the end.
    """
    n, c = F.col("n"), F.col("c")

    def floor_of(other: Column) -> Column:
        need = F.ceil((n + other) * percent / (100 + percent) - 1e-9)
        return need - F.ceil(F.greatest(n, other) * percent / 100 - 1e-9) + 1

    low, high = F.greatest(least, F.ceil(n * percent / 100 - 1e-9)), F.least(most, F.floor(n * 100 / percent + 1e-9))
    fall = percent / 100 - percent / (100 + percent)
    ends = [floor_of(F.greatest(low, high - back)) for back in range(int(1 / fall) + 1)]
    return (low <= high) & (c >= F.least(floor_of(low), *ends))


def _unions(block: pd.DataFrame) -> pd.DataFrame:
    """The bitmap of a block's token union, as wide as its narrowest member's."""
    maps = [np.frombuffer(b, np.uint8) for b in block["union"]]
    size = min(map(len, maps))
    union = np.bitwise_or.reduce([_folded(m, size) for m in maps])
    return block.iloc[:1].assign(union=[union.tobytes()])


def _may_link(percent: int):
    """Rows (rep, n, grp, blk, bits, union, least_n, single) whose bitmaps allow a link.

    A query's bit that the union lacks is a token that no member has, so those bits bound the
    overlap from above; with a single member the same holds the other way round.
    """

    def run(batches):
        for batch in batches:
            keep = []
            for n, bits, union, least, single in zip(*(batch.column(c).to_pylist() for c in (1, 4, 5, 6, 7))):
                mine, theirs = np.frombuffer(bits, np.uint8), np.frombuffer(union, np.uint8)
                size = min(len(mine), len(theirs))
                mine, theirs = _folded(mine, size), _folded(theirs, size)
                most = n - int(np.bitwise_count(mine & ~theirs).sum())
                if single:
                    most = min(most, least - int(np.bitwise_count(theirs & ~mine).sum()))
                keep.append(100 * most >= percent * (n + max(least, most) - most))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(4)], names=["rep", "n", "grp", "blk"])

    return run


def _links(asked: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges between queries asked(rep, n, grp, blk) and members(rep, grp, blk), blocks of both bounded."""
    load = asked.groupBy("grp", "blk").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("parts"))
    asks = asked.join(load, ["grp", "blk"]).select(
        "rep", "grp", "blk", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int").alias("part"),
        F.lit(True).alias("asks"))
    shown = members.join(load, ["grp", "blk"]).select(
        "rep", "grp", "blk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(False).alias("asks"))
    rows = asks.unionByName(shown).join(sets, "rep")
    return rows.groupBy("grp", "blk", "part").applyInPandas(_open_groups(percent), "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id), one row per input row.

    A document's set is that of its distinct `size`-word shingles (words: runs of anything
    but ASCII white space, A-Z lower-cased; with fewer words the whole sequence is the one
    shingle; tokens are 64-bit hashes). Two documents link when 100 * overlap >= percent *
    union; component_id is the smallest doc_id that links reach.

    Equal sets are one representative. Any two linked sets share one of their rarest
    (100 - percent) % tokens; ordered by counts over all documents, those prefixes are all
    that is shuffled of most documents. Similar documents first form groups: each asks the
    document that most of its prefix tokens name and joins its group if they link. The
    token-group matrix holds each group's union of prefix tokens; a document asks a group it
    is not part of only if it shares as many of them as the sizes demand (`_enough`) and if a
    bitmap of the group's whole token union leaves room for a link (`_may_link`), and opens
    it only if its overlap with that union itself reaches the bound. Groups are cut into
    blocks of bounded size. As a group is connected, the first link into a block will do:
    a group of copies costs a few rows per document, never its pairs.

    Defined cases: a null or empty text, or one of white space, has 0 shingles and links with
    nothing; rows with a null doc_id link with nothing and have a null component_id; rows that
    repeat a doc_id are vertices of one name, each with its own set; an empty table gives an
    empty table; further columns are ignored.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = prepared(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    counts = spark.sparkContext.broadcast(bucket_counts(rows, size))
    signed = stored(rows.mapInArrow(
        _signatures(size, percent, counts),
        "doc_id long, text_hash long, n int, s1 long, s2 long, bits binary, prefix array<long>"), "signatures")
    known = signed.where("n > 0 and doc_id is not null")

    # One representative for each set. rep is the smallest document that has it.
    least = known.groupBy("s1", "s2", "n").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"))
    copies = known.join(least, ["s1", "s2", "n"]).select(
        F.col("doc_id").alias("a"), F.col("first.doc_id").alias("b")).where("a != b").distinct()
    firsts = least.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    reps = known.join(firsts, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    reps = reps.select(F.xxhash64("doc_id", "text_hash").alias("rep"), "doc_id", "text_hash", "n", "bits", "prefix")

    # Tokens that two or more representatives share.
    by_token = Window.partitionBy("token")
    live = stored(reps.select("rep", "n", F.explode("prefix").alias("token")).withColumn(
        "df", F.count(F.lit(1)).over(by_token)).where("df > 1"), "shared-tokens")
    names = stored(reps.select("rep", "doc_id", "text_hash", "bits"), "representatives")
    maps = names.select("rep", "bits")

    def sets_of(wanted: DataFrame) -> DataFrame:
        which = stored(wanted.distinct().join(names.drop("bits"), "rep"), "wanted")
        if which.count() <= BROADCAST_DOCS:  # beyond, both sides are shuffled
            which = F.broadcast(which)
        texts = rows.join(which, ["doc_id", "text_hash"]).select("rep", "text")
        return stored(texts.mapInArrow(_full_sets(size), "rep long, tokens binary"), "sets")

    def allowed(asked: DataFrame, unions: DataFrame, name: str) -> DataFrame:
        rows = asked.join(maps, "rep").join(unions, ["grp", "blk"]).select(
            "rep", "n", "grp", "blk", "bits", "union", "least_n", "single")
        return stored(rows.mapInArrow(_may_link(percent), "rep long, n int, grp long, blk int"), name)

    # Groups: each document asks the leader that most of its tokens name, if the bound lets them link.
    # The original of a group of copies has the tokens of all of them and few of its own.
    typical = F.sum("df").over(Window.partitionBy("rep")) / F.col("n")  # at most one prefix to a window
    named = (live.withColumn("typical", typical)
             .withColumn("leader", F.max(F.struct("typical", "rep", "n")).over(by_token)).where("rep != leader.rep")
             .groupBy("rep", "n", "leader").agg(F.count(F.lit(1)).alias("c"))
             .where(_enough(percent, F.col("leader.n"), F.col("leader.n"))))
    chosen = stored(named.groupBy("rep", "n").agg(F.max(F.struct("c", "leader")).alias("best")).select(
        "rep", "n", F.col("best.leader.rep").alias("grp"), F.lit(0).alias("blk"),
        F.col("best.leader.n").alias("least_n"), F.lit(True).alias("single")), "leaders")
    chosen = allowed(
        chosen, chosen.select("grp", "blk").distinct().join(maps.toDF("grp", "union"), "grp"), "likely-leaders")
    alone = chosen.select("grp").distinct().select(F.col("grp").alias("rep"), "grp", F.lit(0).alias("blk"))
    stars = stored(_links(
        chosen, alone, sets_of(chosen.select("rep").unionAll(alone.select("rep"))), percent), "star-links")
    grouped = connected_components(stars)

    # The matrix: which blocks of which groups have a token.
    placed = live.select("rep", "n").distinct().join(
        grouped.withColumnRenamed("vertex", "rep"), "rep", "left").select(
        "rep", "n", F.coalesce("component_id", "rep").alias("grp"))
    loads = placed.groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    placed = stored(placed.join(loads, "grp").select(
        "rep", "n", "grp", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int").alias("blk")), "groups")
    # Both sides of the join below read this exchange, so both name all columns and neither adds a filter.
    live = live.drop("df").join(placed.select("rep", "grp", "blk"), "rep").where(
        "token is not null and rep is not null and n is not null and grp is not null and blk is not null"
    ).repartition("token")
    sizes = placed.groupBy("grp", "blk").agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), (F.count(F.lit(1)) == 1).alias("single"))
    matrix = live.groupBy("token", "grp", "blk").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count("rep").alias("held"))
    asked = (live.select("token", "rep", "n", F.col("grp").alias("own"), F.col("blk").alias("own_blk"))
             .join(matrix, "token").where("own < grp and held > 0")
             .where((percent * F.col("n") <= 100 * F.col("high")) & (percent * F.col("low") <= 100 * F.col("n")))
             .groupBy("rep", "n", "grp", "blk").agg(F.count("own_blk").alias("c"))
             .join(sizes, ["grp", "blk"])
             .where(_enough(percent, F.col("least_n"), F.col("most_n")))
             .select("rep", "n", "grp", "blk", "least_n", "single"))
    asked = stored(asked, "asked")
    rows_of = (asked.select("grp", "blk", "single").distinct().join(placed.select("rep", "grp", "blk"), ["grp", "blk"])
               .join(maps, "rep").select("grp", "blk", F.col("bits").alias("union"), "single"))
    many = rows_of.where("not single").groupBy("grp", "blk").applyInPandas(
        _unions, "grp long, blk int, union binary, single boolean")
    unions = rows_of.where("single").unionByName(many).drop("single")
    asked = allowed(asked, unions, "likely-asked")
    opened = placed.select("rep", "grp", "blk").join(asked.select("grp", "blk").distinct(), ["grp", "blk"])
    links = stored(_links(
        asked, opened, sets_of(asked.select("rep").unionAll(opened.select("rep"))), percent), "group-links")

    named_edges = stars.unionAll(links)
    names = names.select("rep", "doc_id")
    edges = named_edges.join(names.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), "a").join(
        names.select(F.col("rep").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y")
    found = connected_components(edges.unionAll(copies), "x", "y")
    return signed.join(found.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").select(
        "doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))
