"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, components.

Documents with equal shingle sets form a class first, so copies cost one row each from then on. Classes that share a
band meet their bucket's smallest class (a star, never all pairs); links are confirmed on full shingle sets. Buckets
whose classes then still lie in different components are compared in full, block by block. A pair at or above the
threshold shares none of the bands with a probability below 1e-7, whatever its bucket holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize
from .textbytes import SPACE, U64, combine, flat, mix, slices, words

SIGNATURE, BANDS, ROWS = 128, 32, 4
#: Classes of a bucket that one task compares with about as many others.
BLOCK = 1024
_UNIT = 25  # bits of a rank's fraction; the integer part is the step at which it was drawn


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's word shingles, and the bounds of the rows in them.

    Words are runs without white space, A-Z lower-cased; a row of fewer than ``size`` words is one shingle.
    """
    n = len(offsets) - 1
    row, _, _, h = words(data, offsets, SPACE)
    begin = np.searchsorted(row, np.arange(n + 1), "left")
    full = max(0, len(h) - size + 1)
    parts = combine([h[k : k + full] for k in range(size)]) if full else np.zeros(0, U64)
    inside = row[:full] == row[size - 1 : size - 1 + full] if full else np.zeros(0, bool)
    out, bounds = [], np.zeros(n + 1, np.int64)
    for r in range(n):
        b, e = int(begin[r]), int(begin[r + 1])
        if e - b >= size:
            own = parts[b : e - size + 1]
            own.sort()
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif e > b:
            own = combine([h[b + k : b + k + 1] for k in range(e - b)])
        else:
            own = parts[:0]
        out.append(own)
        bounds[r + 1] = bounds[r] + len(own)
    del inside
    return (np.concatenate(out) if out else np.zeros(0, U64)), bounds


def superminhash(elements: np.ndarray, bounds: np.ndarray, m: int = SIGNATURE) -> np.ndarray:
    """SuperMinHash signatures of the sets ``elements[bounds[i]:bounds[i + 1]]``, one row of m ranks each.

    Every element walks its own random permutation of the m components; at step j it offers j plus a random fraction to
    the component it visits, and a set is done once no later step can lower any of its components.
    """
    n = len(bounds) - 1
    sig = np.full((n, m), 0xFFFFFFFF, np.uint32)
    flat_sig = sig.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    alive, order = elements, np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
    here = np.arange(len(elements))
    for j in range(m):
        if not len(alive):
            break
        with np.errstate(over="ignore"):
            draw = mix(alive + U64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + (((draw & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64)
        visited = order[here, k]
        order[here, k] = order[here, j]
        offer = (np.uint32(j << _UNIT) | (draw >> U64(64 - _UNIT)).astype(np.uint32)).astype(np.uint32)
        np.minimum.at(flat_sig, owner * m + visited, offer)
        live = np.unique(owner)
        open_sets = np.zeros(n, bool)
        open_sets[live] = sig[live].max(axis=1) >= np.uint32(min((j + 1) << _UNIT, 0xFFFFFFFF))
        keep = open_sets[owner]
        if not keep.all():
            alive, owner, here = alive[keep], owner[keep], here[keep]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(U64)
    return np.stack([combine([np.full(len(sig), b, U64), *(rows[:, b, k] for k in range(ROWS))]) for b in range(BANDS)], axis=1) if len(sig) else np.zeros((0, BANDS), U64)


def _set_keys(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set, whatever its order."""
    with np.errstate(over="ignore"):
        sums = []
        for salt in (0x1D8E4E27C47D124F, 0x6C62272E07BB0142):
            total = np.zeros(len(elements) + 1, U64)
            np.cumsum(mix(elements ^ U64(salt)), out=total[1:])
            sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a and set_b (128 bits that name the set), bands (null without shingles)."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j in slices(offsets):
                at = offsets[i : j + 1]
                elements, bounds = shingle_sets(data[at[0] : at[-1]], at - at[0], size)
                a, b = _set_keys(elements, bounds)
                keys = band_keys(superminhash(elements, bounds))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)), mask=pa.array(np.diff(bounds) == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(a), pa.array(b), keys], ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"])

    return _hashed(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _shingles_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cid, shingles of the wanted classes (cid, rep, set_a, set_b), from the text of their first document.

    ``rep`` is that document's id and text hash, so that rows which share a null or repeated id do not meet.
    """
    keyed = wanted.select("cid", "set_a", "set_b", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    texts = _hashed(docs).join(keyed, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))).select("cid", "set_a", "set_b", "text")

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(3))
            for i, j in slices(offsets):
                at = offsets[i : j + 1]
                elements, bounds = shingle_sets(data[at[0] : at[-1]], at - at[0], size)
                a, b = _set_keys(elements, bounds)
                same = (a == batch.column(1).to_numpy()[i:j]) & (b == batch.column(2).to_numpy()[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(elements, bounds)], ["cid", "shingles"]).filter(pa.array(same))

    return texts.mapInArrow(run, "cid long, shingles array<long>").dropDuplicates(["cid"])


def connected_components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that each end of ``edges`` (a, b: long) can reach.

    Smallest labels pass along the edges and jump over their own labels, so rounds grow with the logarithm of a
    component's diameter; each round is a table in the shared folder. No edges give no rows.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        passed = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = materialize(passed.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = moved.where(F.col("old") != F.col("label")).limit(1).count()
        drop(labels) if labels.inputFiles() else None
        labels = moved.select("id", "label")
        if not changed:
            return labels


def _confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold: 100 * intersection >= percent * union."""
    left = shingles.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return joined.select("a", "b", common.alias("x"), (F.size("sa") + F.size("sb")).alias("n")).where(F.col("x") * 100 >= (F.col("n") - F.col("x")) * percent).select("a", "b")


def _block_links(members: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links between different labels in the same bucket: members (bucket, cid, label, n).

    Within a bucket the classes outside its most frequent label (the few) meet all of its classes, in pairs of blocks
    of at most about BLOCK: a bucket that is one component but for some costs little more than its own rows.
    """
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.first("n").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("size", -F.col("label"))).alias("main"), (F.first("n") - F.max("size")).alias("few"), F.first("n").alias("n"))
    n_blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    placed = members.drop("n").join(main.where("few > 0"), "bucket").withColumn("draw", F.xxhash64("cid"))
    block = lambda c: F.pmod("draw", n_blocks(c).cast("long")).cast("int")
    others = lambda c: F.explode(F.sequence(F.lit(0), n_blocks(c) - 1))
    few = placed.where("label != main").select("bucket", "cid", "label", block("few").alias("i"), others("n").alias("j"), F.lit(True).alias("probe"))
    every = placed.select("bucket", "cid", "label", others("few").alias("i"), block("n").alias("j"), F.lit(False).alias("probe"))
    rows = few.union(every).join(shingles, "cid")

    def run(_, group):
        group = group.combine_chunks()
        label, probe, cid = (group.column(c).to_numpy() for c in ("label", "probe", "cid"))
        lists = group.column("shingles").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        _, term = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        often = np.bincount(term)[term] > 1  # others are in no intersection
        row, (kept, term) = np.repeat(np.arange(len(sizes)), sizes)[often], np.unique(term[often], return_inverse=True)
        order = np.argsort(term, kind="stable")
        row, term = row[order], term[order]
        first, second = np.flatnonzero(probe), np.flatnonzero(~probe)
        common = np.zeros((len(first), len(second)), np.float32)
        for c in range(0, len(kept), 2048):
            b, e = np.searchsorted(term, [c, c + 2048])
            x = np.zeros((len(sizes), 2048), np.float32)
            x[row[b:e], term[b:e] - c] = 1
            common += x[first] @ x[second].T
        union = sizes[first][:, None] + sizes[second][None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (label[first][:, None] != label[second][None, :]))
        one, other = cid[first[i]], cid[second[j]]
        _, once = np.unique(np.stack([one, label[second[j]]]), axis=1, return_index=True)  # one link into each label is enough
        return pa.table([pa.array(one[once]), pa.array(other[once])], ["a", "b"])

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable. Null, empty and blank texts have no shingles, link with nothing and keep their doc_id. A
    repeated doc_id counts once for each of its texts. A null doc_id links like any other and is no component's id
    unless all of its documents have none: then that is null. Other columns are ignored; empty in, empty out.
    """
    sig = materialize(signatures(docs, size), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    found = sig.where(F.col("n_shingles") > 0).groupBy("set_a", "set_b").agg(first.alias("rep"), F.first("bands").alias("bands"))
    classes = materialize(found.withColumn("cid", F.monotonically_increasing_id()), "classes")
    banded = classes.select("cid", F.explode("bands").alias("bucket"))
    buckets = materialize(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cid").alias("center")).where("n > 1"), "buckets")
    crowded = materialize(banded.join(buckets.select("bucket", "center"), "bucket"), "banded")
    star = materialize(crowded.where("cid != center").groupBy(F.col("center").alias("a"), F.col("cid").alias("b")).count(), "stars")
    wanted = star.select(F.col("a").alias("cid")).union(star.select(F.col("b").alias("cid"))).distinct()
    shingles = materialize(_shingles_of(docs, classes.select("cid", "rep", "set_a", "set_b").join(wanted, "cid"), size), "shingles")
    best = star.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
    links = materialize(_confirmed(best, shingles, percent), "links")
    labels = connected_components(links)
    a, b = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    apart = star.select("a", "b").join(best, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    links = materialize(links.union(_confirmed(apart, shingles, percent)), "links")
    labels = connected_components(links)
    label_of = labels.select(F.col("id").alias("cid"), "label")
    each = classes.join(label_of, "cid", "left").select("cid", F.coalesce("label", "cid").alias("label"), F.explode("bands").alias("bucket"))
    held = each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum(F.xxhash64("cid").cast("decimal(30,0)")).alias("members")).where("n > 2 and lo != hi")
    once = held.groupBy("members", "n").agg(F.min("bucket").alias("bucket")).select("bucket", "n")  # equal buckets of several bands count once
    links = materialize(links.union(_block_links(each.join(once, "bucket"), shingles, percent)), "links")
    labels = connected_components(links).select(F.col("id").alias("cid"), "label")
    placed = classes.select("cid", "set_a", "set_b", F.col("rep.doc_id").alias("least")).join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = placed.groupBy("label").agg(F.min("least").alias("component"))
    named = placed.join(least, "label").select("set_a", "set_b", "component")
    out = sig.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, five-word shingles, similarity of 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + w - 1], ' ') AS shingle
      FROM (SELECT doc_id, ws, least(5, len(ws)) AS w, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
r AS (SELECT doc_id AS id, doc_id AS reached FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
