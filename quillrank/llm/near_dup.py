"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct 5-word shingles. The sketch has T coordinates; in round i < T each element is hashed
to one bin and one value, in round T + j all elements are hashed to bin j, and a bin keeps its smallest value of its
earliest round, so after 2T rounds every coordinate is filled. Bands of R coordinates make buckets. Documents with
equal sets are one class from the start. In every bucket the class that collides most leads, and the others are held
against it on their full sets. Where a bucket still has several components, the sketches of its classes are compared, and pairs of two components whose sketches agree enough (a short and a fine one) are held against each other on their
full sets. A large bucket is cut into blocks for that, the classes of its largest component apart from the others: those
need no comparison among themselves, so a bucket costs its classes times those outside its largest component. A link is lost only if no band shows it, (1 - 0.85^R)^B = 8e-7 a pair at a similarity of 0.85, or if its
sketches agree six standard deviations less than expected, 1e-8; nothing is capped.

Defined results: null and blank texts have no shingles, link with nothing and stand for themselves; null ids are left
alone as they come (component null, kept false); repeated rows of one id are rows with the same result; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK, U64, Scratch, forgetting, grams, hashed, long_id, mix, seeds, table, texts
from .components import components

SHINGLE, COORDS, ROWS = 5, 120, 5
BANDS = COORDS // ROWS
#: Coordinates of the fine sketch that only documents of shared buckets get.
FINE = 1024
SEEDS, FINE_SEEDS = seeds(2 * COORDS, 10), seeds(2 * FINE, 12)
#: Ids of shared buckets are broadcast up to this many, 16 MB.
BROADCAST_IDS = 2_000_000
#: Classes of a bucket that a worker compares with each other at once.
BLOCK = 1024


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the whole text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, U64)
    w = hashed(words)
    if len(w) < k:  # the whole sequence is one shingle, never equal to a full one
        h = U64(len(w))
        for x in w:
            h = U64((int(h) * 0x9E3779B97F4A7C15 + int(x) + 1) & MASK)
        return mix(np.array([h], U64))
    return np.unique(grams(w, k))


def agreement(coords: int, percent: int) -> int:
    """Coordinates that the sketches of a linked pair share but for six standard deviations."""
    p = percent / 100
    return int(coords * p - 6 * (coords * p * (1 - p)) ** 0.5)


def sketch(s: np.ndarray, t: int = COORDS, seed: np.ndarray = SEEDS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: t coordinates of (round, value)."""
    low = U64(0xFFFFFFFF)
    cur = np.full(t, np.iinfo(np.uint64).max, U64)
    step = max(1, min(t, max(256, 4 * t) // len(s)))
    for lo in range(0, t, step):
        r = np.arange(lo, min(t, lo + step))
        h = mix(s[None, :] ^ seed[r][:, None])
        bins = ((h >> U64(32)) * U64(t)) >> U64(32)
        np.minimum.at(cur, bins.ravel().astype(np.int64), ((r.astype(U64) << U64(32))[:, None] | (h & low)).ravel())
        if cur.max() >> U64(32) < U64(2 * t):
            return cur
    for j in np.flatnonzero(cur >> U64(32) >= U64(2 * t)):
        cur[j] = (U64(t + j) << U64(32)) | (mix(s ^ seed[t + j]) & low).min()
    return cur


def band_hashes(coords: np.ndarray, rows: int = ROWS) -> np.ndarray:
    c = mix(coords + seeds(len(coords), 11)).reshape(-1, rows)
    h = np.zeros(len(c), U64)
    for j in range(rows):
        h = h * U64(0x9E3779B97F4A7C15) + c[:, j]
    return mix(h).view(np.int64)


PROFILE = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"


@forgetting
def profiles(batches):
    """Set size, 128-bit set signature and band hashes of each document."""
    for b in batches:
        n, s1, s2, bands, short = [], [], [], [], []
        for text in texts(b.column("text")):
            s = shingle_set(text)
            n.append(len(s))
            s1.append(int(mix(s).sum(dtype=U64).view(np.int64)) if len(s) else 0)
            s2.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64)) if len(s) else 0)
            coords = sketch(s) if len(s) else np.empty(0, U64)
            bands.append(band_hashes(coords) if len(s) else coords.view(np.int64))
            short.append(marks(coords))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])


def marks(coords: np.ndarray) -> bytes:
    """A byte of each coordinate."""
    return (mix(coords) & U64(255)).astype(np.uint8).tobytes()


@forgetting
def sets(batches):
    """The whole set and the fine sketch of each document of a shared bucket."""
    for b in batches:
        found = [shingle_set(x) for x in texts(b.column("text"))]
        fine = [marks(sketch(s, FINE, FINE_SEEDS)) if len(s) else b"" for s in found]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array(fine, pa.binary())], ["id", "shingles", "fine"])


def finder(percent: int):
    """Groups of rows in order -> the pairs to verify, each from the first bucket that shows it."""

    def near(g: dict[str, np.ndarray]):
        left, right = g["mine"] <= g["other"], g["mine"] >= g["other"]
        li, ri = np.flatnonzero(left), np.flatnonzero(right)
        one_block = bool((g["mine"] == g["other"]).all())
        for at in range(0, len(li), 64):
            i = li[at : at + 64]
            agree = (g["sketch"][i][:, None, :] == g["sketch"][ri][None, :, :]).sum(axis=2, dtype=np.int16)
            x, y = np.nonzero(agree >= agreement(COORDS, percent))
            x, y = i[x], ri[y]
            n1, n2 = g["n"][x], g["n"][y]
            fine = (g["component"][x] != g["component"][y]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
            fine &= (g["id"][x] < g["id"][y]) if one_block else (g["id"][x] != g["id"][y])
            x, y = x[fine], y[fine]
            if len(x):
                earlier = np.arange(BANDS) < g["place"][x][:, None]
                x, y = (v[~((g["bands"][x] == g["bands"][y]) & earlier).any(axis=1)] for v in (x, y))
            if len(x):
                close = np.concatenate([(g["fine"][x[k : k + 8192]] == g["fine"][y[k : k + 8192]]).sum(axis=1) for k in range(0, len(x), 8192)])
                x, y = (v[close >= agreement(FINE, percent)] for v in (x, y))
            yield np.minimum(g["id"][x], g["id"][y]), np.maximum(g["id"][x], g["id"][y])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            whole = pa.Table.from_batches(held)
            last = whole.column("group")[-1].as_py()
            groups = whole.column("group").to_numpy()
            cut = int(np.flatnonzero(groups == last)[0])  # the last group may go on in the next batch
            yield from pairs_of(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    def pairs_of(t: pa.Table):
        if not t.num_rows:
            return
        cols = {k: t.column(k).to_numpy() for k in ("group", "mine", "other", "place", "id", "n", "component")}
        cols["sketch"] = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDS)
        cols["fine"] = np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        cols["bands"] = np.array(t.column("bands").to_pylist(), np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cols["group"])) + 1, [t.num_rows]])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for x, y in near({k: v[lo:hi] for k, v in cols.items()}):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least this similarity."""
    of = lambda x: shingles.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b")
    return rows.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; links are 100 * intersection >= percent * union."""
    scratch = Scratch(spark, "near")
    source = docs.select(long_id(), F.col("text").cast("string").alias("text"))
    prof = scratch.keep(source.mapInArrow(profiles, PROFILE), "profiles")
    key = ["n_shingles", "s1", "s2"]
    whole = prof.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(whole.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    reps = prof.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    banded = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("place", "band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = scratch.keep(banded.join(shared, "band"), "members0")
    reps = scratch.keep(reps.join(members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "bands", "sketch"), "reps")
    near_sizes = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    # Round 1: the class with most collisions leads its bucket.
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    members = scratch.keep(members.join(degree, "id"), "members")
    scratch.drop("members0")
    lead = members.groupBy("band").agg(F.max(F.struct("degree", (-F.col("id")).alias("m"), "id", "n")).alias("l")).select("band", F.col("l.id").alias("lead"), F.col("l.n").alias("lead_n"))
    pairs = members.join(lead, "band").filter("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"), F.col("n").alias("na"), F.col("lead_n").alias("nb"))
    tested = scratch.keep(pairs.filter(near_sizes).select("a", "b").distinct(), "pairs1")
    wanted = members.select("id").distinct()
    wanted = scratch.keep(wanted.withColumnRenamed("id", "doc_id"), "wanted")
    few = wanted.count() <= BROADCAST_IDS  # 8 bytes each; more ids go by a shuffle of the texts
    texts_of = source.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    shingles = scratch.keep(texts_of.mapInArrow(sets, "id long, shingles array<long>, fine binary").dropDuplicates(["id"]), "sets")
    scratch.drop("wanted")
    links = scratch.keep(confirmed(tested, shingles, percent), "links1")

    # Round 2: pairs of different components that share a bucket and whose sketches agree enough.
    comp = scratch.keep(components(links, scratch, "c1"), "comp1")
    now = members.select("band", "place", "id", "n", "size").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    now = now.join(open_, "band", "left_semi").join(reps.select(F.col("doc_id").alias("id"), "bands", "sketch"), "id").join(shingles.select("id", "fine"), "id")
    # Blocks 0 to majors - 1 hold the largest component, the next ones the others; two blocks meet in a group of their own
    # unless both are of the largest component. A small bucket is one block.
    parts = now.groupBy("band", "component").agg(F.count("*").alias("k")).groupBy("band").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("in_all"))
    large = F.broadcast(scratch.keep(parts.filter(F.col("in_all") > BLOCK).select("band", F.col("m.component").alias("major"), F.ceil(F.col("m.k") / BLOCK).cast("int").alias("majors"), F.ceil((F.col("in_all") - F.col("m.k")) / BLOCK).cast("int").alias("minors")), "large"))
    now = now.join(large, "band", "left")  # buckets of more than BLOCK classes, at most one for BLOCK rows and band
    is_major, h = F.col("component") == F.col("major"), F.xxhash64("id")
    mine = F.when(F.col("major").isNull(), 0).when(is_major, F.pmod(h, F.col("majors"))).otherwise(F.col("majors") + F.pmod(h, F.greatest("minors", F.lit(1)))).cast("int")
    met = F.when(F.col("major").isNull(), F.array(F.lit(0))).when(is_major, F.sequence(F.col("majors"), F.col("majors") + F.col("minors") - 1)).otherwise(F.sequence(F.lit(0), F.col("majors") + F.col("minors") - 1))
    spread = now.withColumn("mine", mine).withColumn("other", F.explode(met))
    spread = spread.withColumn("group", F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")))
    cols = ["group", "mine", "other", "place", "id", "n", "component", "bands", "sketch", "fine"]
    new = spread.select(*cols).repartition("group").sortWithinPartitions("group").mapInArrow(finder(percent), "a long, b long")
    new = scratch.keep(new.distinct().join(tested, ["a", "b"], "left_anti"), "pairs2")
    scratch.drop("members", "reps", "comp1", "pairs1", "large")
    links = scratch.keep(links.unionByName(confirmed(new, shingles, percent)), "links2")
    scratch.drop("sets", "pairs2", "links1")
    comp = scratch.keep(components(links, scratch, "c2"), "comp2")
    scratch.drop("links2")
    by_class = classes.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    rows = prof.select("doc_id", *key).join(by_class, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SQL = {
    "op10_near_dup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, seen) AS (SELECT a, a FROM p UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.seen),
c AS (SELECT doc_id, min(seen) AS least FROM r GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least, s.doc_id) AS component_id, s.doc_id = coalesce(least, s.doc_id) AS kept FROM s LEFT JOIN c USING (doc_id)
"""
}
