"""Near-duplicate detection: universal hash minima with banding, verification on full sets, and connected components.

1. One pass numbers the rows and makes each text's shingle set, its digest and a signature of minima under `BANDS * ROWS`
   universal hash functions (a * x + b mod 2^64). Texts with equal sets form a class; only a class's representative (the
   row of the least number) goes on, and only representatives that share a band are read back, by their row numbers.
2. Classes that share a band's minima are candidates. Groups are never expanded into pairs: first every class is verified
   against one class, the least that leads any of its groups; then, where a group still holds several components, each
   member against the group's leader; then whatever group still holds several components is dealt into tiles, and pairs of
   tiles compare all members, first by signature, then on full sets, forgetting pairs that are connected already. The
   tiles lose no link and give at most one link for each member. A group of n members that no link joins costs n * n
   comparisons of signatures there, in tiles of bounded size.
3. Links join into components by alternating large-star and small-star; labels are updated between the steps.

A pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6; the signature check before a full
comparison asks for half of the minima, which a pair of 0.75 misses by more than six standard deviations.

Defined results: null and empty texts, and texts without words, have no shingles and stand alone (component_id is their
doc_id); texts of any length are taken whole; repeated rows are linked; a row with null doc_id belongs to its class but gives no component_id, and stands
alone (component_id null, kept) only if its component has no doc_id; of rows that tie in doc_id the first written stands for the component; an empty table
gives an empty result; other columns pass through whatever their names, but for those that begin with two underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import types as T

from docflow.llm.components import components
from docflow.llm.shared import BLOCK, ROW, arrow_schema, at_rows, by_block, discard, id_of, in_blocks, located, materialize, numbered, slices, table_of, text_of, tidy

WORDS = 5
BANDS, ROWS = 32, 4
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members of a tile, and bytes of its texts.
TILE, TILE_BYTES = 512, 4 << 20
#: Rows that one copy of a leader's set serves.
SERVED = 64
BATCH_BYTES = 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, from the golden ratio
_random = np.random.default_rng(20)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct hashes (64 bits) of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = _mixed(total * MIX + hashes[k : len(hashes) - size + 1 + k])
    return np.unique(total)


def signature_of(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (FACTORS[:, None] * shingles[None, at : at + 512] + TERMS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys from (n, BANDS * ROWS) minima; the band is part of the key."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        key = _mixed(key * MIX + rows[:, :, k])
    return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __n (size of the shingle set), __set (its digest) and __signature; null where there are no shingles."""
    source = docs if dict(docs.dtypes)[text] == "string" else docs.withColumn("__text", text_of(text))
    read = text if source is docs else "__text"
    schema = T.StructType([*source.schema.fields, *table_of("__n long, __set binary, __signature binary").fields])
    arrow = arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, read, BATCH_BYTES):
                sizes, sets, signatures = [], [], []
                for body in batch.column(batch.schema.get_field_index(read)).to_pylist():
                    shingles = shingle_set(body or "")
                    sizes.append(len(shingles))
                    sets.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                    signatures.append(signature_of(shingles).tobytes() if len(shingles) else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(signatures, pa.binary())], schema=arrow)

    return source.mapInArrow(tidy(run), schema).drop(*({"__text"} - set(docs.columns)))


def banded(classes: DataFrame) -> DataFrame:
    """key, node: the bands' keys of each class."""
    schema = table_of("key long, node long")
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], schema=arrow)

    return classes.select("node", "signature").mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """links a, b: the pairs (leader, node) that are confirmed on full sets. A leader's set is sent once for each SERVED rows.

    A leader's shares go to one task after the other, so that those of a hot leader are spread evenly.
    """
    counted = materialize(pairs.groupBy("leader").agg(F.count("*").alias("n")).withColumn("shares", F.ceil(F.col("n") / SERVED).cast("int")), "near-shares")  # as a table, so that the join can be split at a leader of many
    served = pairs.join(counted, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"))
    # who is compared with whom goes to the blocks of the texts, which move once: to their leader's task
    members = at_rows(texts, located(served, "node"), "inner").select("leader", "share", F.lit(1).alias("member"), F.col(ROW).alias("node"), "text")
    shares = located(counted.select("leader", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")), "leader")
    leaders = at_rows(texts, shares, "inner").select(F.col(ROW).alias("leader"), "share", F.lit(0).alias("member"), F.col(ROW).alias("node"), "text")
    schema = table_of("a long, b long")
    arrow = arrow_schema(schema)

    def run(batches):
        current, own = None, None
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                a, b = [], []
                for leader, share, member, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if not member:
                        current, own = (leader, share), shingle_set(text)
                    elif current == (leader, share) and linked(own, shingle_set(text)):
                        a.append(leader)
                        b.append(node)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.xxhash64("leader") + F.col("share"), F.lit(tasks)).cast("int")
    dealt = members.unionByName(leaders).repartitionById(tasks, turn).sortWithinPartitions("leader", "share", "member")
    with by_block(pairs.sparkSession):
        found = materialize(dealt.mapInArrow(tidy(run), schema), "near-links")
    discard(counted)
    return found


def _labelled(frame: DataFrame, labels: DataFrame, node: str, root: str) -> DataFrame:
    return frame.join(labels.select(F.col("node").alias(node), F.col("root").alias(f"__{root}")), node, "left").withColumn(root, F.coalesce(f"__{root}", node)).drop(f"__{root}")


def _tiles(members: DataFrame, count: DataFrame) -> DataFrame:
    """members(key, node, ...) dealt to pairs of tiles (i <= j) of each key; side 0 or 1 (2: both, when i = j)."""
    dealt = members.join(count, "key").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1)
    return dealt.select(*members.columns, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), side.alias("side"))


def _groups(batches, largest: str):
    """key and rows of runs of rows with equal (key, i, j), which arrive side by side; a batch is read in slices by its largest column."""
    current, rows = None, []
    for whole in batches:
        for batch in slices(whole, largest, BATCH_BYTES):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != current:
                    if rows:
                        yield current[0], rows
                    current, rows = row[:3], []
                rows.append(row[3:])
    if rows:
        yield current[0], rows


def _agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima agree, for all pairs of rows. Of each minimum one byte is compared: a chance agreement in 256 can only add."""
    if len(a) * len(b) <= 512:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2)
    total, same = np.zeros((len(a), len(b)), np.uint8), np.empty((len(a), len(b)), bool)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        np.equal(x[:, None], y[None, :], out=same)
        np.add(total, same.view(np.uint8), out=total)
    return total


def _agreeing(key: int, rows: list, block: int = 128):
    """For rows (side, node, root, signature, ...) yields indices (x, y) of pairs of different roots whose minima agree in half.

    A pair that shares several groups is looked at in the one of its first common band only.
    """
    signatures = np.frombuffer(b"".join(r[3] for r in rows), "<u4").reshape(len(rows), -1)
    short, keys = signatures.astype(np.uint8), band_keys(signatures)
    side, root = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], np.int64)
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    for at in range(0, len(left), block):
        mine = left[at : at + block]
        same = _agreements(short[mine], short[right])
        x, y = np.nonzero((same >= signatures.shape[1] // 2) & (root[mine][:, None] != root[right][None, :]))
        x, y = mine[x], right[y]
        once = (side[x] != 2) | (x < y)  # a tile against itself has every pair twice
        x, y = x[once], y[once]
        for part in range(0, len(x), 4096):
            p, q = x[part : part + 4096], y[part : part + 4096]
            first = (keys[p] == keys[q]).argmax(axis=1)
            here = keys[p, first] == key
            yield from zip(p[here].tolist(), q[here].tolist())


def tiled_links(buckets: DataFrame, classes: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """links between members of buckets(key, node) that are in different components: the exact way for what stars leave open."""
    rooted = _labelled(buckets, labels, "node", "root")
    open_keys = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    count = materialize(open_keys.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "near-open")
    members = rooted.join(count.select("key"), "key", "left_semi").join(classes.select("node", "signature"), "node").select("key", "node", "root", "signature")
    found = table_of("key long, node long")
    arrow = arrow_schema(found)

    def screen(batches):
        for key, rows in _groups(batches, "signature"):
            nodes = sorted({i for pair in _agreeing(key, rows) for i in pair})
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(nodes), pa.int64()), pa.array([rows[i][1] for i in nodes], pa.int64())], schema=arrow)

    order = ["key", "i", "j"]
    screened = _tiles(members, count).repartition(*order).sortWithinPartitions(*order)
    suspects = materialize(screened.select("key", "i", "j", "side", "node", "root", "signature").mapInArrow(tidy(screen), found).distinct(), "near-suspects")
    sized = at_rows(texts.select(BLOCK, ROW, F.length("text").alias("size")), located(suspects, "node"), "inner").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    with by_block(buckets.sparkSession):
        again = materialize(sized.select("key", F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("size") / TILE_BYTES)).cast("int").alias("tiles")), "near-again")
    named = _labelled(suspects, labels, "node", "root").join(classes.select("node", "signature"), "node")
    held = at_rows(texts, located(named, "node"), "inner").select("key", F.col(ROW).alias("node"), "root", "signature", "text")
    schema = table_of("a long, b long")
    links = arrow_schema(schema)

    def compare(batches):
        for key, rows in _groups(batches, "text"):
            sets: dict[int, np.ndarray] = {}
            parent: dict[int, int] = {}

            def top(x):
                while x in parent:
                    x = parent[x]
                return x

            a, b = [], []
            for x, y in _agreeing(key, rows):
                p, q = top(rows[x][2]), top(rows[y][2])
                if p == q:
                    continue
                for i in (x, y):
                    if i not in sets:
                        sets[i] = shingle_set(rows[i][4])
                if linked(sets[x], sets[y]):
                    parent[max(p, q)] = min(p, q)
                    a.append(rows[x][1])
                    b.append(rows[y][1])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=links)

    dealt = _tiles(held, again).repartition(*order).sortWithinPartitions(*order).select("key", "i", "j", "side", "node", "root", "signature", "text")
    with by_block(buckets.sparkSession):
        found = materialize(dealt.mapInArrow(tidy(compare), schema), "near-tile-links")
    discard(count, suspects, again)
    return found


def components_of(table: DataFrame, n_blocks: int, text: str = "text") -> DataFrame:
    """Per row of a numbered table(doc_id, text, and the columns of `signed`): BLOCK, ROW, doc_id, n_shingles, component_id, first_row (the row that stands for its component)."""
    spark = table.sparkSession
    rows = table.select(BLOCK, ROW, "doc_id", F.col("__n").alias("n_shingles"), F.col("__set").alias("set_key"), F.col("__signature").alias("signature"))
    some = rows.where("set_key IS NOT NULL")
    classes = materialize(some.groupBy("set_key").agg(F.min(ROW).alias("node"), F.min("doc_id").alias("least_doc"), F.first("signature").alias("signature"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(ROW).alias("row"))).alias("first")), "near-classes")
    bands = materialize(banded(classes), "near-bands")
    leaders = materialize(bands.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"), "near-leaders")
    buckets = materialize(bands.join(leaders, "key").select("key", "node", "leader"), "near-buckets")
    discard(bands, leaders)
    with by_block(spark):  # only texts of candidates are read back, by their rows
        wanted = located(buckets.select("node").distinct(), "node")
        texts = in_blocks(at_rows(table.select(BLOCK, ROW, text_of(text).alias("text")), wanted, "left_semi"), "near-texts", n_blocks)
    # first step: one leader for each class
    pairs = materialize(buckets.groupBy("node").agg(F.min("leader").alias("leader")).where("node != leader"), "near-pairs")
    links = verified(pairs, texts)
    labels = components(links)
    discard(pairs, links)
    # second step: the leaders of groups that still hold several components, where the signatures agree in half
    pairs = _labelled(_labelled(buckets.where("node != leader").select("node", "leader").distinct(), labels, "node", "p"), labels, "leader", "q").where("p != q").select("node", "leader")
    signature = classes.select("node", "signature")
    agreeing = F.size(F.filter(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda i: F.substring(F.col("s"), i * 4 + 1, F.lit(4)) == F.substring(F.col("t"), i * 4 + 1, F.lit(4))))
    both = pairs.join(signature.withColumnRenamed("signature", "s"), "node").join(signature.select(F.col("node").alias("leader"), F.col("signature").alias("t")), "leader")
    pairs = materialize(both.where(agreeing >= BANDS * ROWS // 2).select("node", "leader"), "near-pairs")
    labels = _joined(labels, verified(pairs, texts))
    # third step: all members against all others, in tiles, where groups are still open
    labels = _joined(labels, tiled_links(buckets.select("key", "node"), classes, labels, texts))
    discard(pairs, buckets, texts)
    labelled = _labelled(classes, labels, "node", "root")
    least = materialize(labelled.groupBy("root").agg(F.min("least_doc").alias("component_id"), F.min("first").alias("first")), "near-components")
    known = materialize(labelled.join(least.withColumnRenamed("first", "first_row"), "root").select("set_key", "component_id", F.col("first_row.row").alias("first_row")), "near-known")  # as a table, so that the join can be split at a set of many rows
    discard(least, labels, classes)
    single = rows.where("set_key IS NULL").select(BLOCK, ROW, "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col(ROW).alias("first_row"))
    found = materialize(some.join(known, "set_key").select(single.columns).unionByName(single), "near-found")
    discard(known)
    return found


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links; a component counts as a star around its root. Without links nothing is done."""
    if links.isEmpty():
        discard(links)
        return labels
    found = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    discard(labels, links)
    return found


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: row, doc_id, n_shingles, component_id, kept, first_row (the row that stands for its component)."""
    table = numbered(signed(docs.select(id_of(doc_id).alias("doc_id"), text_of(text).alias("text"))), "near-rows")
    found = components_of(table, table._buckets)
    discard(table)
    return found.select(F.col(ROW).alias("row"), "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "first_row")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, with the columns of docs: of the smallest doc_id. Only texts of candidates are shuffled."""
    table = numbered(signed(docs.withColumn("__id", id_of(doc_id)), text), "near-rows")
    found = components_of(table.select(BLOCK, ROW, F.col("__id").alias("doc_id"), F.col(text).alias("__body"), "__n", "__set", "__signature"), table._buckets, "__body")
    with by_block(docs.sparkSession):
        result = materialize(at_rows(table, found.where(F.col(ROW) == F.col("first_row")).select(BLOCK, ROW), "left_semi").select(docs.columns), "near-kept")
    discard(table, found)
    return result
