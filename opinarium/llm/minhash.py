"""Near-duplicates by ProbMinHash sketches, banding and exact verification.

Every text's weighted five-word shingles arrive at the registers of its sketch
as Poisson processes whose rates are the weights; a shingle stops once its
next arrival comes after the latest first arrival of all registers. Two
sketches agree in a register with the probability Jaccard similarity of the
weighted shingles. Each distinct shingle has the weight 1 here, however often
it stands in its text, as then that is about the Jaccard similarity of the
sets, by which links are judged. Bands of registers name buckets.

Links are pairs of texts that share a bucket and whose sets of shingles have
a Jaccard similarity of 0.8 or more, verified on the whole texts. In each
bucket all members are first compared with the smallest. What that and the
links' components leave apart is then compared member by member: the rows
outside a bucket's largest component against all its rows, in blocks. So a
component is whole although nothing emits all pairs of a bucket.

Words end at ASCII white space, as they are; a text of under five words is
one shingle; null texts and texts without words link with nothing but count
as copies of equal texts. Copies share a class. A class is named by its smallest doc_id;
rows with a null doc_id are classes of their own (null, kept). Repeated rows
share a class and are all returned. An empty table gives an empty table;
columns other than doc_id and text are not read. doc_id is the key: texts
that share one are one node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, connected_components, importable, mix, remove, shingle_hashes, text_column, written

WIDTH, SIMILARITY = 5, 0.8
ROWS, BANDS = 4, 20
REGISTERS = ROWS * BANDS
#: The second comparison has longer sketches; its pairs are verified if this share of registers agrees: 0.8 less 4.5 standard deviations.
FINE, AGREE = 512, 0.72
#: Rows on a side of a block of the second comparison.
BLOCK = 256
#: Bytes of text that are sketched at once.
SLICE = 1 << 20


def sketches(rows: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """uint32 registers for each row of distinct shingle hashes and weights (at least one shingle each)."""
    n = len(rows)
    element = np.concatenate([h for h, _ in rows])
    weight = np.concatenate([w for _, w in rows])
    owner = np.repeat(np.arange(n), [len(h) for h, _ in rows])
    arrival = np.zeros(len(element))
    first = np.full(n * registers, np.inf)
    out = np.zeros(n * registers, np.uint32)
    whole, place = out.reshape(n, registers), np.arange(n)
    turn = 0
    with np.errstate(over="ignore"):
        while len(element):
            turn += 1
            step = mix(element + np.uint64(2 * turn) * np.uint64(0x9E3779B97F4A7C15))
            arrival = arrival - np.log(((step >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740993.0) / weight
            slot = owner * registers + (mix(step ^ np.uint64(0xA5A5A5A55A5A5A5A)) % np.uint64(registers)).astype(np.int64)
            before = first[slot]
            np.minimum.at(first, slot, arrival)
            won = (arrival < before) & (arrival == first[slot])
            out[slot[won]] = (mix(element[won]) >> np.uint64(32)).astype(np.uint32)
            live = arrival < first.reshape(n, registers).max(1)[owner]
            element, weight, owner, arrival = element[live], weight[live], owner[live], arrival[live]
            still = np.unique(owner)
            if 2 * len(still) < n:  # finished rows leave
                whole[place] = out.reshape(n, registers)
                place, first, out = place[still], first.reshape(n, registers)[still].ravel(), out.reshape(n, registers)[still].ravel()
                owner, n = np.searchsorted(still, owner), len(still)
    whole[place] = out.reshape(n, registers)
    return whole


def weighted(text: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(shingle_hashes(text, width))
    return distinct, np.ones(len(distinct))


def _sketch(texts: list[str]) -> list[list]:
    rows = [weighted(t.encode("utf-8", "surrogatepass")) for t in texts]
    some = [i for i, (h, _) in enumerate(rows) if len(h)]
    out: list[bytes | None] = [None] * len(texts)
    for i, s in zip(some, sketches([rows[i] for i in some]) if some else ()):
        out[i] = s.astype("<u4").tobytes()
    return [out]


def _fine(texts: list[str]) -> list[list]:
    """16 bits of each of FINE registers, and the sorted distinct shingles, for texts with words."""
    rows = [weighted(t.encode("utf-8", "surrogatepass")) for t in texts]
    return [[s.astype("<u2").tobytes() for s in sketches(rows, FINE)] if rows else [], [h.astype("<u8").tobytes() for h, _ in rows]]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity; texts: (node, text), written."""
    ends = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    ends = ends.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def make(lefts, rights):
        seen: dict[str, np.ndarray] = {}

        def distinct(text):
            found = seen.get(text)
            if found is None:
                if len(seen) > 64:
                    seen.clear()
                found = seen[text] = np.unique(shingle_hashes(text.encode("utf-8", "surrogatepass"), WIDTH))
            return found

        return [[jaccard(distinct(x), distinct(y)) for x, y in zip(lefts, rights)]]

    return add_columns(ends, T.StructType([T.StructField("similarity", T.DoubleType())]), make, ["text_a", "text_b"], sliced="text_b").select("a", "b", "similarity")


def _apart(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) between nodes of other components: in each block a spanning forest of those verified.

    rows: block key columns bucket, i, j, then left (whether on the left),
    node, component, bands (the node's buckets in order), sketch and shingles.
    A pair is compared in the first bucket that it shares.
    """
    importable(rows.sparkSession)
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "left", "node")

    def links(bucket: int, group: list[dict]) -> Iterator[tuple[int, int]]:
        left = [r for r in group if r["left"]]
        right = [r for r in group if not r["left"]]
        if not left or not right:
            return
        y = np.frombuffer(b"".join(r["sketch"] for r in right), "<u2").reshape(len(right), -1)
        bands = np.array([r["bands"] for r in right])
        component = np.array([r["component"] for r in right])
        shingles = [np.frombuffer(r["shingles"], "<u8") for r in right]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for r in left:
            mine, own = np.frombuffer(r["sketch"], "<u2"), np.frombuffer(r["shingles"], "<u8")
            near = np.flatnonzero((y == mine).sum(1) >= AGREE * FINE)
            near = near[component[near] != r["component"]]
            same = bands[near] == np.array(r["bands"])
            for k in near[np.array(r["bands"])[same.argmax(1)] == bucket].tolist():
                p, q = root(r["component"]), root(int(component[k]))
                if p != q and jaccard(own, shingles[k]) >= similarity:
                    parent[max(p, q)] = min(p, q)
                    yield r["node"], right[k]["node"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def told():
            found = list(links(key[0], group))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    at = (row["bucket"], row["i"], row["j"])
                    if at != key:
                        if group:
                            yield told()
                        key, group = at, []
                    group.append(row)
        if group:
            yield told()

    return dealt.mapInArrow(run, "src long, dst long")


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text"))
    return docs.withColumn("digest", _digest("text"))


def _digest(text: str):
    return F.unhex(F.sha2(text_column(text).cast("binary"), 256))


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, sketch) for each row of docs (doc_id, text, digest)."""
    made = T.StructType([T.StructField("sketch", T.BinaryType())])
    return written(add_columns(docs, made, _sketch, ["text"], sliced="text", most=SLICE).drop("text"), "sketches")


def _classes(docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(digest, id, class_id), the least node of each text's component.

    nodes: (digest, id, node, sketch), written: for each distinct text its number and the doc_id of a row of docs (doc_id, text, digest) that has it.
    """
    size = 4 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("sketch", 1 + size * k, size)) for k in range(BANDS)))
    banded = nodes.where("sketch is not null").select("node", F.explode(keys).alias("bucket"))
    buckets = written(banded.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").select("bucket", "center"), "buckets")
    members = written(banded.join(buckets, "bucket"), "members")
    stars = written(members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    # Only texts in some bucket with another are read again.
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "id", F.col("digest").alias("of"))
    texts = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))).groupBy("node").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")
    links = written(_verify(stars, texts).where(F.col("similarity") >= similarity).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    found = connected_components(links)

    # Buckets whose members are not all in one component.
    placed = members.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("most")).where("parts > 1")
    mixed = written(mixed.select("bucket", "all", (F.col("all") - F.col("most.n")).alias("rest"), F.col("most.component").alias("main")), "mixed")
    if not mixed.isEmpty():
        rows = placed.join(mixed, "bucket")
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
        left = rows.where("component <> main").withColumn("i", own("rest")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks("all") - 1))).withColumn("left", F.lit(True))
        right = rows.withColumn("j", own("all")).withColumn("i", F.explode(F.sequence(F.lit(0), blocks("rest") - 1))).withColumn("left", F.lit(False))
        columns = ["bucket", "i", "j", "left", "node", "component"]
        made = T.StructType([T.StructField("sketch", T.BinaryType()), T.StructField("shingles", T.BinaryType())])
        fine = add_columns(texts.join(rows.select("node").distinct(), "node"), made, _fine, ["text"], sliced="text", most=SLICE).select("node", "sketch", "shingles")
        fine = written(fine.join(nodes.select("node", keys.alias("bands")), "node"), "fine-sketches")
        sided = left.select(columns).union(right.select(columns)).join(fine, "node")
        fresh = written(_apart(sided, similarity), "more-links")
        if not fresh.isEmpty():
            remove(found)
            found = connected_components(links.union(fresh))
        remove(fine, fresh)

    classes = written(nodes.join(found, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("class_id")), "classes")
    remove(nodes, buckets, members, stars, texts, links, mixed, found)
    return classes


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and kept (whether doc_id names its class) for each row of df."""
    docs = _rows(df, doc_id, text)
    seen = _sketched(docs)
    named = seen.where("doc_id is not null")
    nodes = named.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")).withColumn("node", F.col("id"))
    classes = _classes(docs, written(nodes, "nodes"), similarity).drop("id")
    joined = named.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    return joined.union(seen.where("doc_id is null").select("doc_id", F.lit(None).cast("long"), F.lit(True)))


def first_of_each(df: DataFrame) -> DataFrame:
    """One row of df for each class of texts, with df's columns: of the least doc_id, or of none where all are null.

    Rows are told apart by doc_id and text, so a text stays or goes whatever
    other texts have its doc_id; of rows equal in both any one stays.
    """
    docs = _rows(df, "doc_id", "text")
    seen = _sketched(docs)
    # min() passes over nulls: a text's id is null only if no row of it has one.
    nodes = seen.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id())
    classes = _classes(docs, written(nodes, "nodes"), SIMILARITY)
    chosen = classes.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "digest")).alias("row"))
    chosen = written(chosen.select(F.col("row.id").alias("_id_kept"), F.col("row.digest").alias("_digest_kept")), "chosen")
    same = F.col("_id").eqNullSafe(F.col("_id_kept")) & (F.col("_digest") == F.col("_digest_kept"))
    several = seen.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count("*").alias("n")).where("n > 1")
    several = written(several.join(chosen, same, "left_semi").select(F.col("_id").alias("_id_kept"), F.col("_digest").alias("_digest_kept")), "several")
    remove(seen, classes)

    marked = df.withColumns({"_id": F.col("doc_id").cast("long"), "_digest": _digest("text")})
    kept = marked.join(chosen.hint("merge"), same, "left_semi")
    if several.isEmpty():
        return kept.select(df.columns)
    repeated = marked.join(several.hint("merge"), same, "left_semi").groupBy("_id", "_digest").agg(F.first(F.struct(*df.columns)).alias("_row")).select("_row.*")
    return kept.join(several.hint("merge"), same, "left_anti").select(df.columns).union(repeated)
