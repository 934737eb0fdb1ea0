"""SimHash near-dedup with BK-trees.

Fingerprints that differ in at most ``radius`` bits are linked.  The 64 bits
are cut into radius + 4 blocks; two linked fingerprints agree on at least four
of them, so they meet in the shard of some choice of four blocks.  Each shard
builds a BK-tree of its distinct fingerprints (children keyed by their integer
Hamming distance to the parent) and searches it for all of them at once,
following only the edges within the radius.

A shard holds distinct fingerprints that agree on four blocks (42 bits or more
at radius 2), so at most 2^22 of them, however many documents share one: a
proven bound of 32 MB.  The trees go to the tasks that own the shards instead
of to all executors, since their number grows with the data.  A shard returns
a spanning star per linked set, and components are then joined by alternating
large-star and small-star steps.

Defined results: null text counts as empty; a text without words has
fingerprint zero, linked like any other; the component id is the smallest id
reachable (a null id only if all are null); repeated rows share a component;
an empty table gives no rows; only the named id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import cut_lineage, map_texts, text_of, text_of

SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included.
    Lower-casing bytes touches A-Z only; splitting them cuts at ASCII spaces."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    parts = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65536):
        ones += np.unpackbits(h[lo:lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(rows: DataFrame, shingle: int = 3, text: str = "text", name: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long; other columns stay, also the text."""
    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]
    return map_texts(rows.withColumn("_text", text_of(rows, text)), make, f"{name} long", keep=rows.columns, text="_text")


class BKTree:
    """Built from an array of distinct values.  ``links`` runs all queries
    down the tree together."""

    def __init__(self, values: np.ndarray):
        self.value: list[np.uint64] = []
        self.children: list[dict[int, int]] = []
        waiting = [(values, -1, 0)]
        while waiting:
            vs, parent, edge = waiting.pop()
            node = len(self.value)
            self.value.append(vs[0])
            self.children.append({})
            if parent >= 0:
                self.children[parent][edge] = node
            if len(vs) > 1:
                d = np.bitwise_count(vs[1:] ^ vs[0])
                waiting += [(vs[1:][d == e], node, int(e)) for e in np.unique(d)]

    def links(self, queries: np.ndarray, radius: int):
        """(query, value) pairs within the radius, as they are found."""
        waiting = [(0, queries)]
        while waiting:
            node, qs = waiting.pop()
            v = self.value[node]
            d = np.bitwise_count(qs ^ v).astype(np.int64)
            near = qs[d <= radius]
            if len(near):
                yield near, v
            for edge, child in self.children[node].items():
                rest = qs[np.abs(d - edge) <= radius]
                if len(rest):
                    waiting.append((child, rest))


def linked_sets(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A star (value, smallest value of its set) for every linked set."""
    values = np.unique(values)
    root = {int(v): int(v) for v in values}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for near, v in BKTree(values).links(values, radius):
        for q in near.tolist():
            a, b = find(q), find(int(v))
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(x, r) for x in root if (r := find(x)) != x]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that connect
    whatever is within the radius."""
    blocks = radius + 4
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen) for chosen in combinations(range(blocks), 4)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    shards = (prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
                                                      for i, m in enumerate(signed)])).alias("s"))
              .groupBy("s.m", "s.key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps"))

    def search(batches):
        for b in batches:
            for fps in b.column(0):
                stars = linked_sets(fps.values.to_numpy().view(np.uint64), radius)
                if stars:
                    pairs = np.array(stars, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return shards.mapInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of the edges (a, b), the root being
    the smallest node.  Alternating large-star and small-star; every round is
    a few grouped minima with map-side combination."""
    def state(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        e = cut_lineage(small)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for the distinct fingerprints of ``prints``."""
    distinct = prints.select("fp").distinct()
    roots = components(links(distinct, radius))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_dedup(docs: DataFrame, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint, component_id."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    prints = cut_lineage(with_fingerprint(rows, shingle).select("doc_id", "fp"))
    per = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(grouped(prints, radius), "fp")
    least = per.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = per.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component (the smallest id, null ids last), with all
    columns as they were."""
    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t, shingle) for t in texts.to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    # Only the text goes to Python; the rows stay in the JVM.
    small = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("doc_id"),
                        prints(text_of(docs, text)).alias("fp"), F.monotonically_increasing_id().alias("at"))
    kept = cut_lineage(small)       # the row numbers and the rows stay together from here on
    groups = kept.select("fp", "doc_id", "at")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first")
    best = (groups.groupBy("fp").agg(first).join(grouped(groups, radius), "fp").groupBy("root").agg(F.min("first").alias("first"))
            .select(F.col("first.at").alias("at")))
    return kept.join(best, "at", "left_semi").select("row.*")
