"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Every hash function keeps its minimum *and* its maximum over a document's shingles, so 64
evaluations give 128 signature values; bands of 4 values make 32 bucket keys.  A pair at the
threshold (Jaccard 0.8) shares no bucket with probability (1 - 0.8**4)**32, about 5e-8.

The work stays linear in the documents and in the links, and no bucket is expanded into pairs:

1.  Documents with equal shingle sets form one class, represented by its smallest id.
2.  Every representative is compared with the smallest one of each of its buckets (a star, not
    all pairs), on full sets; connected components of those links give labels.
3.  What a star cannot decide are buckets that still hold several labels.  Documents that meet a
    large label (more than ``SMALL_LABEL`` documents) are compared with all of it, block by block;
    documents of small labels are compared inside their buckets, again block by block.  A vectorised
    kernel holds one block of about ``BLOCK`` documents, streams the queries that are dealt to it and
    emits links between labels only, so neither pairs nor groups pile up anywhere.
4.  Components of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudent.llm.common import keep_ids, staged
from prudent.llm.shingles import _WordHashes, band_keys, min_max_signatures, shingle_set
from prudent.operators.graph import connected_components

N_HASHES, ROWS, SEED = 64, 4, 20_240_229
#: documents of a block, queries that one copy of a block sees, and documents of a small label, in step 3
BLOCK, QUERIES, SMALL_LABEL = 512, 4096, 64

_SIG = "doc_id long, n_shingles long, fp binary, bands array<long>"


def _signatures(k: int, n_hashes: int, rows: int, seed: int):
    def run(batches):
        cache = _WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 2000):
                sets = [shingle_set(t.as_py(), k, cache) for t in texts.slice(at, 2000)]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if full:
                    keys = band_keys(min_max_signatures([sets[i] for i in full], n_hashes, seed), rows, seed)
                    for i, row in zip(full, keys.view(np.int64)):
                        bands[i] = row
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, 2000),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.data) if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "bands"])
    return run


def _sets(k: int):
    def run(batches):
        cache = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts = batch.column(0).slice(at, 500), batch.column(1).slice(at, 500)
                sets = [shingle_set(t.as_py(), k, cache).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])
    return run


def _shingle_sets(base: DataFrame, ids: DataFrame, k: int, label: str) -> DataFrame:
    """Full sets of the documents named in ``ids`` (one column ``doc_id``), one row per input row."""
    rows = keep_ids(base, ids.select(F.col("doc_id").alias("__id")).distinct(), "doc_id", "__id")
    return staged(rows.mapInArrow(_sets(k), "doc_id long, shingles array<long>"), label)


def _block_links(percent: int):
    """Kernel of step 3: rows sorted by (kind, spot, block, salt, side); side 0 is a block, side 1 its queries.

    Emits the pairs of labels between which it finds a link, not the pairs of documents.
    """
    def run(batches):
        key = block = None
        members: list = []
        labels: list = []
        out: set = set()

        def prepare():
            sizes = np.array([len(m) for m in members])
            vocabulary, ids = np.unique(np.concatenate(members), return_inverse=True)
            return vocabulary, ids, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, np.array(labels), len(set(labels)) == 1

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            sides, names = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            lists = batch.column(6)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            for i in range(batch.num_rows):
                if keys[i] != key:
                    key, members, labels, block = keys[i], [], [], None
                own = values[ends[i]:ends[i + 1]]
                if sides[i] == 0:
                    members.append(own)
                    labels.append(names[i])
                    continue
                if not members:
                    continue
                block = block or prepare()
                vocabulary, ids, starts, sizes, whose, single = block
                if single and (names[i] == labels[0] or (names[i], labels[0]) in out):
                    continue
                at = np.searchsorted(vocabulary, own)
                at[at == len(vocabulary)] = 0
                mark = np.zeros(len(vocabulary), np.int32)
                mark[at[vocabulary[at] == own]] = 1
                both = np.add.reduceat(mark[ids], starts)
                linked = (100 * both >= percent * (sizes + len(own) - both)) & (whose != names[i])
                out.update((names[i], int(x)) for x in np.unique(whose[linked]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                                  pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])
                out = set()
    return run


def _undecided(shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the stars leave open: (small, large) labels that meet in a bucket, and bucket rows of small labels.

    A bucket's head has been compared with everyone in it.  Among the others, a label of more than
    ``SMALL_LABEL`` documents is a ``large`` one and is compared as a whole; documents of small
    labels are compared inside the buckets that hold several of them.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    named = labels.join(sizes, "label").select(F.col("rep").alias("lrep"), "label", "size")
    rows = staged(shared.where("rep <> head").join(named, F.col("rep") == F.col("lrep"), "left")
                  .select("key", "rep", F.coalesce("label", "rep").alias("label"),
                          F.coalesce("size", F.lit(1)).alias("size")), "open-buckets")
    small = rows.where(F.col("size") <= SMALL_LABEL)
    crowded = small.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("docs"))
    crowded = crowded.where("a < b").select(F.col("key").alias("ckey"), "docs")
    small = small.join(crowded, F.col("key") == F.col("ckey")).select("key", "rep", "label", "docs")
    large = rows.where(F.col("size") > SMALL_LABEL).select(F.col("key").alias("lkey"), F.col("label").alias("large"), "size").distinct()
    pairs = (rows.select("key", F.col("label").alias("small"), F.col("size").alias("small_size")).distinct()
             .join(large, (F.col("key") == F.col("lkey")) & (F.col("small") != F.col("large"))
                   & ((F.col("small_size") <= SMALL_LABEL) | (F.col("small") < F.col("large"))))
             .select("small", "large", "size").distinct())
    return staged(pairs, "open-labels"), staged(small, "open-small")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80, n_hashes: int = N_HASHES, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``percent`` / 100 or more.

    Returns per input row ``doc_id, n_shingles, component_id, kept``: ``component_id`` is the
    smallest id reachable over links (itself included), ``kept`` marks the one that stays.

    Cases: a null or empty text, or one without words, has no shingles and links with nothing.  A
    row with a null id can't be named: it links with nothing, its component is null and it is kept.
    Rows that share an id are one document: each gives an output row, with its own ``n_shingles``, and
    the document links through any of its texts.
    Ties don't arise (the smallest id stands for a group).  Other columns of ``docs`` are ignored,
    whatever their names.  An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = staged(base.mapInArrow(_signatures(shingle_words, n_hashes, rows, seed), _SIG), "signatures")
    linkable = sigs.where("fp IS NOT NULL AND doc_id IS NOT NULL")

    # 1. one class per shingle set
    classes = staged(linkable.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")),
                     "classes")
    # 2. stars
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    heads = staged(buckets.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last"))
                   .where("head < last").select("key", "head"), "heads")
    shared = staged(buckets.join(heads.withColumnRenamed("key", "hkey"), F.col("key") == F.col("hkey"))
                    .select("key", "rep", "head"), "buckets")
    stars = staged(shared.where("rep <> head").select("head", "rep").distinct(), "stars")
    ids = stars.select(F.col("head").alias("doc_id")).unionByName(stars.select(F.col("rep").alias("doc_id")))
    sets = _shingle_sets(base, ids, shingle_words, "sets")
    left, right = (sets.select(F.col("doc_id").alias(f"{x}_id"), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    links = staged(
        stars.join(left, F.col("head") == F.col("a_id")).join(right, F.col("rep") == F.col("b_id"))
        .where(100 * both >= percent * (F.size("a_set") + F.size("b_set") - both))
        .select(F.col("head").alias("u"), F.col("rep").alias("v")), "links")
    labels = staged(connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("label")), "labels")

    # 3. labels that still meet in a bucket
    pairs, small = _undecided(shared, labels)
    named = labels.select(F.col("rep").alias("lrep"), F.col("label").alias("of"))
    meet = pairs.select(F.col("small").alias("label")).unionByName(pairs.select(F.col("large").alias("label"))).distinct()
    docs_of = staged(meet.join(named, F.col("label") == F.col("of"), "left")
                     .select("label", F.coalesce("lrep", "label").alias("doc_id")), "open-members")
    own = _shingle_sets(base, docs_of.select("doc_id").unionByName(small.select(F.col("rep").alias("doc_id"))),
                        shingle_words, "open-sets")
    per_large = pairs.groupBy("large").agg(F.count("*").alias("queries"), F.max("size").alias("size"))
    zero = F.lit(0).cast("long")
    blocks, salts = F.ceil(F.col("size") / BLOCK).cast("long"), F.ceil(F.col("queries") / QUERIES).cast("long")
    chunks = F.ceil(F.col("docs") / BLOCK).cast("long")
    have, small = docs_of.join(own, "doc_id"), small.join(own, F.col("rep") == F.col("doc_id"))
    parts = [
        have.join(per_large, F.col("label") == F.col("large"))
        .select(F.lit(0).alias("kind"), F.col("large").alias("spot"), F.pmod(F.xxhash64("doc_id"), blocks).alias("block"),
                F.explode(F.sequence(zero, salts - 1)).alias("salt"), F.lit(0).alias("side"), "label", "shingles"),
        have.join(pairs.select("small", "large").join(per_large, "large"), F.col("label") == F.col("small"))
        .select(F.lit(0).alias("kind"), F.col("large").alias("spot"), F.explode(F.sequence(zero, blocks - 1)).alias("block"),
                F.pmod(F.xxhash64("small"), salts).alias("salt"), F.lit(1).alias("side"), "label", "shingles"),
        small.select(F.lit(1).alias("kind"), F.col("key").alias("spot"), F.pmod(F.xxhash64("rep"), chunks).alias("block"),
                     zero.alias("salt"), F.lit(0).alias("side"), "label", "shingles"),
        small.select(F.lit(1).alias("kind"), F.col("key").alias("spot"), F.explode(F.sequence(zero, chunks - 1)).alias("block"),
                     zero.alias("salt"), F.lit(1).alias("side"), "label", "shingles")]
    keys = ["kind", "spot", "block", "salt"]
    more = (parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).repartition(*keys)
            .sortWithinPartitions(*keys, "side").mapInArrow(_block_links(percent), "u long, v long").distinct())

    # 4. components of all links; texts that share an id belong together
    several = (linkable.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
               .select(F.col("doc_id").alias("sid")))
    same = (linkable.select("doc_id", "fp").join(several, F.col("doc_id") == F.col("sid"), "left_semi")
            .join(classes.select(F.col("fp").alias("cfp"), "rep"), F.col("fp") == F.col("cfp"))
            .select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    links = staged(labels.select(F.col("rep").alias("u"), F.col("label").alias("v")).unionByName(more).unionByName(same), "all-links")
    final = staged(connected_components(links), "components")
    named = classes.select(F.col("fp").alias("cfp"), "rep").join(final, F.col("rep") == F.col("node"), "left") \
                   .select("cfp", F.coalesce("component", "rep").alias("component"))
    named = staged(named, "classes-named")
    return (sigs.select("doc_id", "n_shingles", "fp")
            .join(named, (F.col("fp") == F.col("cfp")) & F.col("doc_id").isNotNull(), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                    F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept")))
