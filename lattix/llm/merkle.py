"""A Merkle manifest of documents whose leaves are placed by rank queries on bitmaps.

1. Each row becomes a leaf: digests and ids move from here on, no texts.
2. The ids of a group are a bitmap of 64-bit words, of which only those with a bit are kept;
   partial words are merged by ``bit_or``. A directory of popcounts stands over the words: counts
   before a word within its 2 ** 10 words, before those within 2 ** 16 of them, and so on, so that
   no step sees more than 2 ** 16 rows of a group together whatever the ids are.
3. A leaf's place in its group is what the directory says of its word plus the popcount of the
   lower bits of that word: leaves are never sorted.
4. Places are keys of slot arrays: ``place >> 12`` names the array, the low bits the slot. An array
   is reduced by four levels of eight in one step; its root goes to slot ``key & 4095`` of the next
   array, until one node is left. Groups of ids then hang under one more tree in the same way.
5. Paths (what stands before and after a node in its run, level by level) are handed down from
   the root to the arrays of leaves, which give each leaf its proof and fold it.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattix.llm.common import CRC_TABLE, checkpoint, crc32_sql, in_order

FANOUT = 8
LEVELS = 4
SLOTS_BITS = 3 * LEVELS
SLOTS = 1 << SLOTS_BITS
#: Bits of a word's number that each level of the directory takes; the last level has the rest.
DIRECTORY = (10, 16, 16)
#: The word of rows without an id; it is below every other.
NO_ID = -(1 << 58)
PATH = "array<struct<before:string,after:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(*fields: Column) -> Column:
    """SHA-256 of the fields, each with its length in bytes in front, or a dash for a null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(part, fields)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, word, leaf, changed) of each row; changed is the tampered leaf, null where nothing is tampered with."""
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "n_chars", "text")))
    head = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return row.select(
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("tree"),
        "doc_id",
        F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_ID)).alias("word"),
        digest_of(*head, F.col("text")).alias("leaf"),
        F.when(hit, digest_of(*head, F.translate("text", UPPER, LOWER))).alias("changed"),
    )


def directory(leaf: DataFrame) -> DataFrame:
    """(tree, word, bits, n, before): the bitmap's words, their rows, and the rows of lower words of the tree."""
    bit = F.expr("shiftleft(1L, cast(coalesce(doc_id & 63, 0) as int))")
    words = checkpoint(leaf.groupBy("tree", "word").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")))
    levels = [words.select("tree", F.col("word").alias("node"), "n")]
    for bits in DIRECTORY:
        levels.append(levels[-1].groupBy("tree", F.shiftright("node", bits).alias("node")).agg(F.sum("n").alias("n")))
    before = F.sum("n").over(W.partitionBy("tree", "up").orderBy("node").rowsBetween(W.unboundedPreceding, -1))
    offset = None
    for own, bits in reversed(list(zip(levels, (*DIRECTORY, None), strict=True))):
        up = own.withColumn("up", F.lit(0) if bits is None else F.shiftright("node", bits)).withColumn("before", F.coalesce(before, F.lit(0)))
        if offset is not None:
            up = up.join(offset.select("tree", F.col("node").alias("up"), F.col("before").alias("base")), ["tree", "up"]).withColumn("before", F.col("before") + F.col("base"))
        offset = up.select("tree", "node", "before")
    return words.join(offset.withColumnRenamed("node", "word"), ["tree", "word"])


def placed(leaf: DataFrame) -> DataFrame:
    """leaf with ``place``, its rank in its tree: by id, rows without one first, rows of one id by their digests."""
    words = checkpoint(directory(leaf))
    rows = leaf.join(words, ["tree", "word"])
    lower = F.expr("bit_count(bits & ~shiftleft(-1L, cast(coalesce(doc_id & 63, 0) as int)))")
    keep = ["tree", "doc_id", "leaf", "changed"]
    single = F.col("n") == F.expr("bit_count(bits)")
    out = rows.where(single).select(*keep, (F.col("before") + lower).alias("place"))
    if words.where(~single).limit(1).count():
        again = in_order(rows.where(~single).withColumn("salt", F.monotonically_increasing_id()), "tree", "word", "doc_id", "leaf", "changed", "salt")
        first = again.groupBy("tree", "word").agg(F.min("at").alias("first"))
        out = out.union(again.join(first, ["tree", "word"]).select(*keep, (F.col("before") + F.col("at") - F.col("first")).alias("place")))
    return out


def run_of(level: list[str], k: int) -> tuple[str, str]:
    """What stands before and after node k in its run of FANOUT."""
    at = k - k % FANOUT
    return "".join(level[at:k]), "".join(level[k + 1 : at + FANOUT])


def reduced(key: int, nodes: list[str]) -> list[list[str]]:
    """The levels over the nodes of slot array ``key``, the last of one node: LEVELS of them, or what an array that is its tree's only one needs."""
    out = [nodes]
    alone = key == 0 and len(nodes) < SLOTS
    while len(out[-1]) > 1 or not alone and len(out) <= LEVELS:
        below = out[-1]
        out.append([sha256("".join(below[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
    return out


def path_of(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    return [run_of(level, slot >> 3 * j) for j, level in enumerate(levels[:-1])]


def slots(pairs: list[dict], field: str) -> list[str]:
    """The slot array of (slot, digest) pairs, as hex text."""
    out = [""] * len(pairs)
    for p in pairs:
        out[p["slot"]] = p[field].hex()
    return out


def climb(nodes: DataFrame) -> DataFrame:
    """(tree, key, h, paths) of the slot arrays of nodes (tree, node, h): root and the path of each slot."""
    grouped = nodes.groupBy("tree", F.shiftright("node", SLOTS_BITS).alias("key")).agg(F.collect_list(F.struct((F.col("node") % SLOTS).cast("int").alias("slot"), "h")).alias("nodes"))

    def rows(batches):
        for b in batches:
            for tree, key, nodes_ in zip(*(b.column(c).to_pylist() for c in ("tree", "key", "nodes")), strict=True):
                levels = reduced(key, slots(nodes_, "h"))
                paths = [[{"before": x, "after": y} for x, y in path_of(levels, k)] for k in range(len(nodes_))]
                yield pa.RecordBatch.from_pylist([{"tree": tree, "key": key, "h": bytes.fromhex(levels[-1][0]), "paths": paths}], schema=_CLIMBED)

    return checkpoint(grouped.mapInArrow(rows, f"tree string, key long, h binary, paths array<{PATH}>"))


_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
_CLIMBED = pa.schema([("tree", pa.string()), ("key", pa.int64()), ("h", pa.binary()), ("paths", pa.list_(pa.list_(_STEP)))])


def tops(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, h) of the tree over each tree's nodes, and the climb() of each step."""
    steps = []
    while (nodes.agg(F.max("node")).head()[0] or 0) > 0:
        steps.append(climb(nodes))
        nodes = steps[-1].select("tree", F.col("key").alias("node"), "h")
    return nodes.select("tree", "h"), steps


def slot_paths(step: DataFrame) -> DataFrame:
    """(tree, node, key, path) of the nodes of a climb()."""
    return step.select("tree", "key", F.posexplode("paths").alias("slot", "path")).select("tree", (F.col("key") * SLOTS + F.col("slot")).alias("node"), "key", "path")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs.

    Leaves of a language ascend by doc_id. Rows without an id come first and are not tampered with; rows that
    repeat an id go by their digests and are leaves each. Null columns are a dash in the digest, empty and
    very long texts are texts like others, an empty table gives an empty result, other columns are ignored.
    """
    leaf = checkpoint(leaves(docs))
    entry = F.struct((F.col("place") % SLOTS).cast("int").alias("slot"), "doc_id", "leaf", "changed")
    blocks = checkpoint(placed(leaf).groupBy("tree", F.shiftright("place", SLOTS_BITS).alias("key")).agg(F.collect_list(entry).alias("nodes")))

    def roots(batches):
        for b in batches:
            key, nodes = b.column("key").to_pylist(), b.column("nodes").to_pylist()
            h = [bytes.fromhex(reduced(k, slots(n, "leaf"))[-1][0]) for k, n in zip(key, nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("key"), pa.array(h, pa.binary())], ["tree", "node", "h"])

    subroots, steps = tops(checkpoint(blocks.mapInArrow(roots, "tree string, node long, h binary")))
    over = in_order(subroots, "tree").select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("at").alias("node"), "h")
    root, root_steps = tops(over.drop("own"))
    # from the top down: (tree, node, path) of what stands under each step
    path = root.select("tree", F.lit(0).cast("long").alias("node"), F.array().cast(PATH).alias("path"), F.lower(F.hex("h")).alias("root"))
    path = handed_down(path, root_steps)
    path = over.join(path.drop("tree"), "node").select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("node"), "path", "root", F.lower(F.hex("h")).alias("subroot"))
    path = handed_down(path, steps)
    whole = blocks.join(path.withColumnRenamed("node", "key"), ["tree", "key"])
    return whole.select("key", "nodes", "path", "root", "subroot").mapInArrow(_proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def handed_down(path: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """path (tree, node, path, ...) of the top carried to the nodes under the last of the steps, the first of them."""
    for step in reversed(steps):
        own = slot_paths(step).withColumnRenamed("path", "own")
        up = path.withColumnRenamed("node", "key")
        path = checkpoint(own.join(up, ["tree", "key"]).withColumn("path", F.concat("own", "path")).drop("own", "key"))
    return path


def _proofs(batches):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for b in batches:
        for key, nodes, path, root, subroot in zip(*(b.column(c).to_pylist() for c in ("key", "nodes", "path", "root", "subroot")), strict=True):
            levels = reduced(key, slots(nodes, "leaf"))
            upper = [(p["before"], p["after"]) for p in path]
            above = "".join(x + y for x, y in upper)
            ids, leaf, proof, folded = [], [], [], []
            for p in nodes:
                k = p["slot"]
                own = path_of(levels, k)
                proof.append(sha256(("".join(x + y for x, y in own) + above).encode()).hexdigest())
                h = (p["leaf"] if p["changed"] is None else p["changed"]).hex()
                for x, y in own:
                    h = sha256((x + h + y).encode()).hexdigest()
                for x, y in upper:
                    h = sha256((x + h + y).encode()).hexdigest()
                ids.append(p["doc_id"])
                leaf.append(levels[0][k])
                folded.append(h)
            n = len(nodes)
            columns = [pa.array(ids, pa.int64()), pa.array(leaf), pa.array([subroot] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), pa.array([h == root for h in folded])]
            yield pa.RecordBatch.from_arrays(columns, names)


def oracle_sql(depth: int = 8, root_depth: int = 3) -> str:
    """The same rows by one query a level: up to 8 ** depth rows of a language and 8 ** root_depth languages."""
    field = lambda c: f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    digest = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    ctes = [
        CRC_TABLE,
        f"leaf AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {digest('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {digest(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents, crc)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS k0 FROM leaf)",
        "n0 AS (SELECT tree, k0 AS k, leaf AS h FROM a0)",
    ]

    def climbs(level: str, n: int) -> str:
        """One level up where a tree has several nodes, with the run of each; others stay."""
        for j in range(n):
            ctes.append(f"{level}r{j} AS (SELECT tree, k // 8 AS up, list(h ORDER BY k) AS run, (count(*) OVER (PARTITION BY tree)) AS runs FROM {level}{j} GROUP BY tree, k // 8)")
            ctes.append(f"{level}{j + 1} AS (SELECT tree, up AS k, CASE WHEN runs = 1 AND len(run) = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {level}r{j})")
        return f"{level}{n}"

    top = climbs("n", depth)
    ctes.append(f"s AS (SELECT tree AS own, h, row_number() OVER (ORDER BY tree) - 1 AS k FROM {top} WHERE k = 0)")
    ctes.append("m0 AS (SELECT 0 AS tree, k, h FROM s)")
    root = climbs("m", root_depth)
    joins, steps = [], []
    for j in range(depth):
        joins.append(f"JOIN nr{j} ON nr{j}.tree = a0.tree AND nr{j}.up = k0 // {8 ** (j + 1)}")
        steps.append((f"nr{j}", f"(k0 // {8**j} % 8)"))
    joins.append("JOIN s ON s.own = a0.tree")
    for j in range(root_depth):
        joins.append(f"JOIN mr{j} ON mr{j}.up = s.k // {8 ** (j + 1)}")
        steps.append((f"mr{j}", f"(s.k // {8**j} % 8)"))
    before = [f"array_to_string({t}.run[1:{k}], '') AS b{i}, array_to_string({t}.run[{k} + 2:], '') AS e{i}, ({t}.runs > 1 OR len({t}.run) > 1) AS live{i}" for i, (t, k) in enumerate(steps)]
    ctes.append(f"f0 AS (SELECT doc_id, leaf, s.h AS subroot, coalesce(changed, leaf) AS fold0, (SELECT h FROM {root}) AS root, {', '.join(before)} FROM a0 {' '.join(joins)})")
    for i in range(len(steps)):
        ctes.append(f"f{i + 1} AS (SELECT * EXCLUDE (fold{i}), CASE WHEN live{i} THEN sha256(b{i} || fold{i} || e{i}) ELSE fold{i} END AS fold{i + 1} FROM f{i})")
    last = len(steps)
    proof = " || ".join(f"b{i} || e{i}" for i in range(last))
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, fold{last} AS folded_root, fold{last} = root AS verified FROM f{last}"
