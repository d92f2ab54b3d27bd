"""The operators as queries over the given tables, each with SQL for the same rows.

Views over the tables stand in for the inputs of a design study: designs keyed by orders, a
fragment library from part, likelihood arrays from embeddings, reads from documents, candidates
from events, features from labelled documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattix.functions import combos, junctions, sequences
from lattix.jobs import fragment_library, train
from lattix.jobs.calibrate import calibrate
from lattix.jobs.distill import distill
from lattix.jobs.rank import rank
from lattix.operators import alignment, bands, calibration, library, memo, ranking, reports, sampling, scorers, training
from lattix.session import scratch, ship
from lattix.sources import weights
from lattix.sources.readers import fragment_name

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# Coefficients of a calibration fitted before, with its threshold.
ARTIFACT = {
    "features": ["global_score", "junction_mean", "junction_min"], "coefficients": [0.473269358259, -1.038567688283, -0.633699502359],
    "intercept": -44.816793890128, "s_min_threshold": -41.84422365824381,
}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


# views, and the same in SQL

IDX = "((({0}) % 4194304) * 2654435761) % 4194304"
COMBO = "list_aggregate(list_transform(range(10, -1, -1), lambda p: substr('ALFM', ((({0}) >> (2 * p)) & 3)::INT + 1, 1)), 'string_agg', '')"
V_COMBO = f"v_combo AS (SELECT *, {COMBO.format('idx')} AS combo FROM (SELECT o_orderkey, o_custkey, {IDX.format('o_orderkey')} AS idx FROM orders))"
V_LIB = """v_lib AS (SELECT substr('ALFM', (k % 4 + 1)::INT, 1) AS letter, (k // 4 + 1)::INT AS slot, seq, weight FROM
  (SELECT p_partkey % 44 AS k, upper(replace(arg_min(p_name, p_partkey), ' ', '')) AS seq, round(avg(p_retailprice), 4) AS weight FROM part GROUP BY 1))"""
V_BUILT = f"""{V_COMBO}, {V_LIB}, v_built AS (SELECT o_orderkey, any_value(combo) AS combo, string_agg(seq, '' ORDER BY s.i) AS seq, list(length(seq)::INT ORDER BY s.i) AS lens
  FROM v_combo, range(1, 12) s(i), v_lib WHERE v_lib.slot = s.i AND v_lib.letter = substr(combo, s.i::INT, 1) GROUP BY o_orderkey)"""
V_LL = """v_ll AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS tok, len(embedding)::INT AS n,
  list_concat([NULL::DOUBLE], list_slice(list_transform(embedding, lambda x: x::DOUBLE), 2, 64)) AS ll FROM embeddings),
v_b AS (SELECT *, list_transform(range(1, 11), lambda i: (i * (n // 11))::INT) AS bounds FROM v_ll),
v_j AS (SELECT *, list_transform(bounds, lambda b: list_avg(list_slice(ll, greatest(1, b - 25 + 1), least(n, b + 25)))) AS j FROM v_b)"""
V_DNA = "v_dna AS (SELECT doc_id, translate(sha256(coalesce(text, '')), '0123456789abcdef', 'ACGTACGTACGTACGT') AS dna FROM documents)"
#: Letters of whole texts as nucleotides, for reads of thousands of bases.
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = ("ACGT" * 13)[: len(_LETTERS)]
V_LONG = f"v_dna AS (SELECT doc_id, regexp_replace(translate(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g'), '{_LETTERS}', '{_BASES}'), '[^ACGT]', '', 'g') AS dna FROM documents)"
V_LAB = f"""v_lab AS (SELECT doc_id, quality AS label, {COMBO.format(IDX.format('doc_id'))} AS combo_compact, -n_chars / 100.0::DOUBLE AS global_score,
  -((doc_id * 37) % 1000) / 10.0::DOUBLE AS junction_mean, CASE WHEN doc_id % 13 = 0 THEN 'nan'::DOUBLE ELSE -((doc_id * 37) % 1000) / 10.0::DOUBLE - doc_id % 17 END AS junction_min
  FROM labels JOIN documents USING (doc_id))"""
V_CAND = """v_cand AS (SELECT event_id AS gen_idx, user_id % 40 AS parent, (hash_slot)::INT AS slot, value AS adjusted_score, (event_id % 4)::INT AS stop_count,
  (user_id * 7 % 300 + 25 * hash_slot)::INT AS parent_start, (user_id * 7 % 300 + 25 * hash_slot + event_id % 60)::INT AS parent_end
  FROM (SELECT *, event_id % 11 + 1 AS hash_slot FROM events))"""


def designs(spark: SparkSession, d: str) -> DataFrame:
    idx = (F.col("o_orderkey") % combos.SPACE * 2654435761) % combos.SPACE
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", idx.alias("idx")).withColumn("combo", combos.from_index(F.col("idx")))


def parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = table(spark, d, "part").groupBy((F.col("p_partkey") % 44).alias("k")).agg(F.upper(F.replace(F.min_by("p_name", "p_partkey"), F.lit(" "), F.lit(""))).alias("aa_sequence"), F.round(F.avg("p_retailprice"), 4).alias("weight"))
    return rows.select(F.substr(F.lit(combos.ALPHABET), (k % 4 + 1).cast("int"), F.lit(1)).alias("letter"), F.expr("cast(k div 4 + 1 as int)").alias("slot"), "aa_sequence", "weight")


def built(spark: SparkSession, d: str) -> DataFrame:
    return library.built(designs(spark, d), parts(spark, d), "combo")


def likelihoods(spark: SparkSession, d: str) -> DataFrame:
    tok = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", tok.alias("tok")).withColumn("n", F.size("tok"))
    return rows.withColumn("ll", junctions.from_tokens(F.col("tok"))).withColumn("bounds", junctions.boundaries(sequences.uniform_split(F.col("n")))).withColumn("j", junctions.window_means(F.col("ll"), F.col("bounds")))


def reads(spark: SparkSession, d: str) -> DataFrame:
    digest = sequences.sha256(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.translate(digest, "0123456789abcdef", "ACGTACGTACGTACGT").alias("dna"))


def long_reads(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as reads: their letters A-Z as nucleotides."""
    letters_ = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]", "")
    return table(spark, d, "documents").select("doc_id", F.translate(letters_, _LETTERS, _BASES).alias("dna"))


def dealt(spark: SparkSession, d: str, own: Callable[[SparkSession, str], DataFrame] = reads) -> DataFrame:
    """The reads with a parent and a slot by their ids."""
    k = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(44))
    return own(spark, d).withColumn("parent", F.substr(F.lit(combos.ALPHABET), (k % 4 + 1).cast("int"), F.lit(1))).withColumn("slot", (F.floor(k / 4) + 1).cast("int"))


def features(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    mean = -((i * 37) % 1000) / F.lit(10.0)
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), combos.from_index(((i % combos.SPACE) * 2654435761) % combos.SPACE).alias("combo_compact"), (-F.col("n_chars") / F.lit(100.0)).alias("global_score"),
        mean.alias("junction_mean"), F.when(i % 13 == 0, float("nan")).otherwise(mean - i % 17).alias("junction_min"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    slot, at = F.col("event_id") % 11 + 1, F.col("user_id") * 7 % 300
    return table(spark, d, "events").select(
        F.col("event_id").alias("gen_idx"), (F.col("user_id") % 40).alias("parent"), slot.cast("int").alias("slot"), F.col("value").alias("adjusted_score"), (F.col("event_id") % 4).cast("int").alias("stop_count"),
        (at + 25 * slot).cast("int").alias("parent_start"), (at + 25 * slot + F.col("event_id") % 60).cast("int").alias("parent_end"))


def joined(values, digits: int | None = None):
    values = F.transform(values, lambda x: F.round(x, digits)) if digits else values
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


# encodings


@query(f"WITH {V_COMBO} SELECT o_orderkey, idx, combo FROM v_combo")
def combo_from_index(spark, d):
    return designs(spark, d).select("o_orderkey", "idx", "combo")


_RAW = "CASE WHEN o_orderkey % 7 = 0 THEN substr(combo, 1, 10) || 'X' WHEN o_orderkey % 11 = 0 THEN ' ' || lower(combo) || ' ' WHEN o_orderkey % 13 = 0 THEN substr(combo, 1, 9) ELSE combo END"


@query(f"""WITH {V_COMBO} SELECT o_orderkey, upper(trim(raw)) AS normal, regexp_full_match(upper(trim(raw)), '[ALFM]{{11}}') AS valid,
  CASE WHEN length(trim(raw)) <> 11 THEN 'length ' || length(trim(raw)) WHEN NOT regexp_full_match(upper(trim(raw)), '[ALFM]{{11}}') THEN 'letters X' END AS problem
  FROM (SELECT o_orderkey, {_RAW} AS raw FROM v_combo)""")
def combo_validate(spark, d):
    raw = F.expr(_RAW)
    return designs(spark, d).select("o_orderkey", raw.alias("raw")).select("o_orderkey", combos.normalised(F.col("raw")).alias("normal"), combos.is_valid(F.col("raw")).alias("valid"), combos.problem(F.col("raw")).alias("problem"))


@query(f"""WITH {V_COMBO} SELECT o_orderkey, i::INT AS slot, CASE substr(combo, i::INT, 1) WHEN 'A' THEN 'As' WHEN 'L' THEN 'Lb' WHEN 'F' THEN 'Fn' ELSE 'Mb2' END AS parent FROM v_combo, range(1, 12) s(i)""")
def combo_decode_keys(spark, d):
    return designs(spark, d).select("o_orderkey", F.explode(combos.domain_keys(F.col("combo"))).alias("k")).select("o_orderkey", "k.slot", "k.parent")


@query(f"WITH {V_COMBO} SELECT o_orderkey, combo, idx AS again FROM v_combo")
def combo_encode_roundtrip(spark, d):
    return designs(spark, d).select("o_orderkey", combos.encoded(combos.decoded(F.col("combo"))).alias("combo")).withColumn("again", combos.to_index(F.col("combo")))


@query(f"WITH {V_BUILT} SELECT o_orderkey, seq, sha256(seq) AS seq_hash FROM v_built")
def build_sequence(spark, d):
    return built(spark, d).select("o_orderkey", F.col("sequence_aa").alias("seq"), sequences.sha256(F.col("sequence_aa")).alias("seq_hash"))


@query(f"""WITH {V_BUILT} SELECT o_orderkey, array_to_string(lens, ',') AS lengths, array_to_string(list_transform(range(1, 11), lambda i: list_sum(list_slice(lens, 1, i))::INT), ',') AS bounds FROM v_built""")
def domain_lengths_boundaries(spark, d):
    return built(spark, d).select("o_orderkey", joined(F.col("domain_lengths")).alias("lengths"), joined(junctions.boundaries(F.col("domain_lengths"))).alias("bounds"))


@query(f"""WITH {V_BUILT} SELECT o_orderkey, 'lm|m1|spaces=0|maxlen=100|wL=25|wR=25|' || sha256(substr(seq, 1, 100)) || '|' || sha256(array_to_string(lens, ',')) AS key FROM v_built""")
def cache_key(spark, d):
    return built(spark, d).select("o_orderkey", sequences.cache_key(F.col("sequence_aa"), F.col("domain_lengths"), "m1", most=100).alias("key"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, length(text)::INT AS n FROM documents")
def seq_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", sequences.sha256(F.coalesce("text", F.lit(""))).alias("hash"), F.length("text").alias("n"))


_TOKENS = "list_transform(string_split(upper(replace(p_name, ' ', '')), ''), lambda c: coalesce(list_position(['<pad>','<bos>','A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y','B','J','O','U','Z'], c) - 1, 27))"


@query(f"SELECT p_partkey, array_to_string({_TOKENS}, ',') AS ids FROM part")
def token_encode(spark, d):
    text = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    return table(spark, d, "part").select("p_partkey", joined(sequences.tokens(text)).alias("ids"))


@query(f"SELECT p_partkey, array_to_string(list_concat([1], list_slice(t, 1, len(t) - 1)), ',') AS ids FROM (SELECT p_partkey, {_TOKENS} AS t FROM part)")
def bos_shift(spark, d):
    text = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    return table(spark, d, "part").select("p_partkey", joined(sequences.shifted(sequences.tokens(text))).alias("ids"))


@query("SELECT doc_id, array_to_string(list_transform(range(1, 12), lambda i: CASE WHEN i < 11 THEN n_chars // 11 ELSE n_chars - 10 * (n_chars // 11) END), ',') AS lengths FROM documents")
def uniform_split(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(sequences.uniform_split(F.col("n_chars"))).alias("lengths"))


# arrays


@query(f"WITH {V_LL} SELECT vec_id, i::INT AS k, round(j[i], 6) AS score FROM v_j, range(1, 11) s(i)")
def junction_windows(spark, d):
    return likelihoods(spark, d).select("vec_id", F.posexplode("j").alias("k", "score")).select("vec_id", (F.col("k") + 1).alias("k"), F.round("score", 6).alias("score"))


@query(f"""WITH {V_LL}, s AS (SELECT vec_id, unnest(ll) AS value, unnest(range(n)) AS pos FROM v_b), w AS (SELECT vec_id, unnest(bounds) AS b, unnest(range(1, 11)) AS k FROM v_b)
SELECT w.vec_id, w.k::INT AS k, round(avg(value), 6) AS score FROM w LEFT JOIN s ON s.vec_id = w.vec_id AND pos >= b - 25 AND pos < b + 25 GROUP BY w.vec_id, w.k""")
def junction_windows_long(spark, d):
    """The same from tables with a row for each place and each boundary."""
    rows = likelihoods(spark, d).select(F.col("vec_id").alias("seq"), "ll", "bounds")
    scores = rows.select("seq", F.posexplode("ll").alias("pos", "value"))
    bounds = rows.select("seq", F.posexplode("bounds").alias("k", "at")).select("seq", (F.col("k") + 1).alias("junction"), "at")
    return bands.window_means(scores, bounds).select(F.col("seq").alias("vec_id"), F.col("junction").alias("k"), F.round("score", 6).alias("score"))


@query(f"WITH {V_LL} SELECT vec_id, " + ", ".join(f"round(j[{k}], 6) AS junction_{k:02d}" for k in range(1, 11)) + " FROM v_j")
def junction_flatten(spark, d):
    rows = likelihoods(spark, d).select("vec_id", *junctions.flat(F.col("j")))
    return rows.select("vec_id", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])


@query(f"WITH {V_LL} SELECT vec_id, round(list_avg(j), 6) AS junction_mean, round(list_min(j), 6) AS junction_min, round(list_avg(tok), 6) AS global_score FROM v_j")
def junction_mean_min(spark, d):
    return likelihoods(spark, d).select("vec_id", F.round(junctions.junction_mean(F.col("j")), 6).alias("junction_mean"), F.round(junctions.junction_min(F.col("j")), 6).alias("junction_min"), F.round(junctions.global_score(F.col("tok")), 6).alias("global_score"))


@query(f"""WITH {V_LL}, r AS (SELECT vec_id, tok, (20 + vec_id % 100)::INT AS m FROM v_ll)
SELECT vec_id, i::INT AS residue, CASE WHEN i > 1 THEN round(tok[least(((i - 2) * 64) // (m - 1), 63) + 1], 6) END AS ll FROM r, range(1, 121) s(i) WHERE i <= m""")
def token_to_residue(spark, d):
    rows = likelihoods(spark, d).withColumn("m", (20 + F.col("vec_id") % 100).cast("int"))
    return rows.select("vec_id", F.posexplode(junctions.to_residues(F.col("tok"), F.col("m"))).alias("k", "ll")).select("vec_id", (F.col("k") + 1).alias("residue"), F.round("ll", 6).alias("ll"))


# reads and proteins


@query(r"""SELECT doc_id, run FROM (SELECT doc_id, u.run, row_number() OVER (PARTITION BY doc_id ORDER BY length(u.run) DESC, u.k) AS n
  FROM documents, unnest(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z*]+')) WITH ORDINALITY u(run, k)) WHERE n = 1 AND length(run) >= 12""")
def longest_run(spark, d):
    return table(spark, d, "documents").select("doc_id", sequences.longest_run(F.col("text"), 12).alias("run")).where("run is not null")


@query(f"WITH {V_DNA} SELECT doc_id, regexp_replace(upper(dna), '[^ACGTN]', '', 'g') AS clean, reverse(translate(dna, 'ACGTN', 'TGCAN')) AS rev FROM v_dna")
def sanitize_revcomp(spark, d):
    return reads(spark, d).select("doc_id", sequences.sanitised(F.col("dna")).alias("clean"), sequences.reverse_complement(F.col("dna")).alias("rev"))


def _frames(reads_: str) -> str:
    """SQL tables that end in ``aa`` (doc_id, gen_idx, orientation, frame, aa_raw): the six frames of v_dna."""
    return f"""{reads_}, frames AS (SELECT doc_id, (3 * o + f)::INT AS gen_idx, CASE o WHEN 0 THEN 'fwd' ELSE 'rev' END AS orientation, f::INT AS frame, CASE o WHEN 0 THEN dna ELSE reverse(translate(dna, 'ACGTN', 'TGCAN')) END AS s
  FROM v_dna, range(0, 2) a(o), range(0, 3) b(f)),
codon AS (SELECT doc_id, gen_idx, unnest(range(0, (length(s) - frame) // 3)) AS i, unnest(regexp_extract_all(substr(s, frame + 1), '...')) AS c FROM frames WHERE length(s) - frame >= 3),
amino AS (SELECT doc_id, gen_idx, string_agg(substr('{sequences.CODE}', (16 * (instr('TCAG', c[1]) - 1) + 4 * (instr('TCAG', c[2]) - 1) + instr('TCAG', c[3]))::INT, 1), '' ORDER BY i) AS aa FROM codon GROUP BY doc_id, gen_idx),
aa AS (SELECT doc_id, gen_idx, orientation, frame, coalesce(aa, '') AS aa_raw FROM frames LEFT JOIN amino USING (doc_id, gen_idx))"""


_FRAMES = _frames(V_DNA)


@query(f"WITH {_frames(V_LONG)} SELECT doc_id, gen_idx, length(aa_raw)::INT AS aa_length, (length(aa_raw) - length(replace(aa_raw, '*', '')))::INT AS stops, sha256(aa_raw) AS aa_hash FROM aa")
def long_read_frames(spark, d):
    """The six frames of whole texts read as nucleotides."""
    aa = F.col("aa_raw")
    return library.six_frame_candidates(long_reads(spark, d)).select("doc_id", "gen_idx", F.length(aa).alias("aa_length"), sequences.count_of(aa, "*").alias("stops"), sequences.sha256(aa).alias("aa_hash"))


@query(f"WITH {_FRAMES} SELECT * FROM aa")
def six_frame_translate(spark, d):
    return library.six_frame_candidates(reads(spark, d)).select("doc_id", "gen_idx", "orientation", "frame", "aa_raw")


@query(f"""WITH {_FRAMES} SELECT doc_id, gen_idx, (length(aa_raw) - length(replace(aa_raw, '*', '')))::INT AS stops, 100.0::DOUBLE - 50 * (length(aa_raw) - length(replace(aa_raw, '*', ''))) AS adjusted_score,
  replace(aa_raw, '*', '') AS clean, CASE WHEN contains(aa_raw, '*') THEN 'stop_in_trimmed' ELSE '' END AS warnings FROM aa""")
def stop_x_penalty(spark, d):
    aa = F.col("aa_raw")
    stops = sequences.count_of(aa, "*")
    return library.six_frame_candidates(reads(spark, d)).select("doc_id", "gen_idx", stops.alias("stops"), sequences.adjusted_score(F.lit(100.0), aa).alias("adjusted_score"), sequences.without_stops(aa).alias("clean"), sequences.warnings(F.lit(False), stops, sequences.x_fraction(aa)).alias("warnings"))


def _aligned(pairs: str) -> str:
    """SQL tables that end in ``al`` (p, score, t0, t1, q0, q1): local alignments of the pairs (p, t, q), a step for each letter of the targets.

    A cell has the best score that ends in it (h) and where that begins (s); d and sd are those of alignments that end in a gap of the query.
    """
    rows = [r.split() for r in alignment.BLOSUM62.strip().split("\n")]
    scores = ", ".join(f"'{x}{y}': {v}" for x, r in zip(alignment.LETTERS, rows, strict=True) for y, v in zip(alignment.LETTERS, r, strict=True))
    letters = alignment.LETTERS
    own = lambda x: f"list_transform(string_split(upper({x}), ''), lambda c: CASE WHEN contains('{letters}', c) THEN c ELSE 'X' END)"
    open_, extend = f"({alignment.OPEN}::DOUBLE)", f"({alignment.EXTEND}::DOUBLE)"
    return f"""bl AS (SELECT MAP {{{scores}}} AS m), pr AS MATERIALIZED (SELECT p, {own('t')} AS t, {own('q')} AS q FROM ({pairs}) WHERE length(t) > 0 AND length(q) > 0),
letter AS MATERIALIZED (SELECT p, i::INT AS i, t[i::INT] AS c FROM pr, range(1, 100000) r(i) WHERE i <= len(t)),
dp AS (SELECT p, q, 0 AS i, j::INT AS j, 0.0::DOUBLE AS h, 0::BIGINT AS s, '-inf'::DOUBLE AS d, 0::BIGINT AS sd FROM pr, range(0, 100000) r(j) WHERE j <= len(q) UNION ALL
  SELECT p, q, i, j, greatest(v, {extend} * j + {open_} - {extend} + best.l), CASE WHEN best IS NULL OR v >= {extend} * j + {open_} - {extend} + best.l THEN sv ELSE best.s END, d, sd FROM (
    SELECT *, max(struct_pack(l := v - {extend} * j, j := j, s := sv)) OVER w AS best FROM (
      SELECT *, CASE WHEN j = 0 THEN 0 ELSE greatest(0, d, match) END AS v, CASE WHEN j > 0 AND match >= greatest(d, 0) THEN begin_ ELSE sd END AS sv FROM (
        SELECT dp.p, q, dp.i + 1 AS i, j, greatest(h + {open_}, d + {extend}) AS d, CASE WHEN d + {extend} > h + {open_} THEN sd ELSE s END AS sd,
          coalesce(lag(h) OVER k + bl.m[letter.c || q[j]], -1e9) AS match, CASE WHEN lag(h) OVER k > 0 THEN lag(s) OVER k ELSE dp.i * (len(q) + 1) + j - 1 END AS begin_
        FROM dp JOIN letter ON letter.p = dp.p AND letter.i = dp.i + 1, bl WINDOW k AS (PARTITION BY dp.p ORDER BY j)))
    WINDOW w AS (PARTITION BY p ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
al AS (SELECT p, max(h) AS score, arg_min(struct_pack(t0 := s // (len(q) + 1), t1 := i, q0 := s % (len(q) + 1), q1 := j), (-h, i, j)) AS x FROM dp WHERE h > 0 GROUP BY p)"""


_PARENTS = "SELECT letter, string_agg(seq, '' ORDER BY slot) AS protein FROM v_lib GROUP BY letter"
_DEALT = "SELECT *, substr('ALFM', (coalesce(doc_id, 0) % 44 % 4 + 1)::INT, 1) AS letter, (coalesce(doc_id, 0) % 44 // 4 + 1)::INT AS slot FROM aa"


@query(f"""WITH RECURSIVE {_FRAMES}, {V_LIB}, dealt AS ({_DEALT}), {_aligned("SELECT (doc_id, gen_idx) AS p, seq AS t, aa_raw AS q FROM dealt JOIN v_lib USING (letter, slot)")}
SELECT doc_id, orientation, frame, letter, slot, score AS align_score, x.t0::INT AS parent_start, x.t1::INT AS parent_end, x.q0::INT AS query_start, x.q1::INT AS query_end FROM dealt JOIN v_lib USING (letter, slot) LEFT JOIN al ON p = (doc_id, gen_idx)""")
def local_alignment(spark, d):
    """All frames of the reads aligned with the fragment, one of 44, that each read is dealt by its id."""
    targets = parts(spark, d).select("letter", "slot", F.col("aa_sequence").alias("target"))
    frames = library.six_frame_candidates(dealt(spark, d)).withColumnRenamed("parent", "letter")
    return alignment.align(frames.join(targets, ["letter", "slot"]), "target", "aa_raw").select("doc_id", "orientation", "frame", "letter", "slot", "align_score", "parent_start", "parent_end", "query_start", "query_end")


@query()
def long_read_alignment(spark, d):
    """All frames of whole texts aligned with the fragment that each text is dealt by its id."""
    targets = parts(spark, d).select("letter", "slot", F.col("aa_sequence").alias("target"))
    frames = library.six_frame_candidates(dealt(spark, d, long_reads)).withColumnRenamed("parent", "letter")
    return alignment.align(frames.join(targets, ["letter", "slot"]), "target", "aa_raw").select("doc_id", "gen_idx", "letter", "slot", "align_score", "parent_start", "parent_end", "query_start", "query_end")


@query()
def translated_candidates(spark, d):
    """All frames of the reads aligned with the protein of their parent, which is its eleven fragments in a row, and scored."""
    slots = F.array_sort(F.collect_list(F.struct("slot", "aa_sequence")))
    proteins = parts(spark, d).groupBy(F.col("letter").alias("parent")).agg(F.array_join(F.transform(slots, lambda s: s["aa_sequence"]), "").alias("protein"))
    return library.translated_candidates(dealt(spark, d), proteins).select(
        "doc_id", "parent", "slot", "gen_idx", "orientation", "frame", "align_score", "parent_start", "parent_end", "query_start", "query_end", "aa_trimmed", "stop_count", "x_fraction", "adjusted_score")


# joins, ranks, selections


@query(f"""WITH {V_COMBO} SELECT o_orderkey, nxt AS other, hamming(combo, c2)::INT AS distance FROM (SELECT *, lead(o_orderkey) OVER w AS nxt, lead(combo) OVER w AS c2 FROM v_combo WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE nxt IS NOT NULL""")
def hamming_pairs(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = designs(spark, d).withColumn("other", F.lead("o_orderkey").over(w)).withColumn("b", F.lead("idx").over(w)).where("other is not null")
    return rows.select("o_orderkey", "other", combos.hamming(F.col("idx"), F.col("b")).alias("distance"))


@query("""WITH d AS (SELECT DISTINCT o_orderkey % 4194304 AS idx FROM orders), n AS (SELECT idx, xor(idx, v << (2 * p.p)) AS other FROM d, range(11) p(p), range(1, 4) v(v))
SELECT n.idx AS a, d.idx AS b, 1 AS distance FROM n JOIN d ON d.idx = n.other WHERE n.idx < d.idx""")
def hamming_near(spark, d):
    """All pairs of designs, numbered by orders, that differ in one slot."""
    return ranking.near_pairs(table(spark, d, "orders").select((F.col("o_orderkey") % combos.SPACE).alias("idx")), 2, blocks=4)


def _shuffled(i: str, half: int, seed: int) -> str:
    """sampling.permuted() in SQL."""
    mask = (1 << half) - 1
    high, low = f"({i} >> {half})", f"({i} & {mask})"
    columns = [f"p0 AS (SELECT {i} AS i, {high} AS high, {low} AS low FROM v_n)"]
    for k, key in enumerate(sampling.round_keys(seed)):
        columns.append(f"p{k + 1} AS (SELECT i, low AS high, xor(high, (((low * low + {key}) * 40503 + low * 2654435761) >> 9) & {mask}) AS low FROM p{k})")
    return ", ".join(columns) + f", p AS (SELECT i, (high << {half}) | low AS idx FROM p{sampling.ROUNDS})"


@query(f"WITH v_n AS (SELECT unnest(range(count(*))) AS n FROM orders), {_shuffled('n', combos.SLOTS, 13)} SELECT idx, {COMBO.format('idx')} AS combo_compact FROM p")
def distinct_designs(spark, d):
    """As many designs as there are orders, drawn without a memory; all of them come before one comes again."""
    return sampling.design_rounds(spark, table(spark, d, "orders").count(), 13)


_SCORE = "global_score + 0.5::DOUBLE * junction_mean + 0.5::DOUBLE * junction_min"
_TOP = f"""{V_LAB}, top AS (SELECT * FROM (SELECT *, CASE WHEN isnan({_SCORE}) THEN NULL ELSE {_SCORE} END AS student_rank_score FROM v_lab) ORDER BY student_rank_score DESC NULLS LAST, combo_compact, doc_id LIMIT 100)"""


def shortlist(spark, d, k=100):
    scored = features(spark, d).withColumn("student_rank_score", junctions.orderable(junctions.rank_score(F.col("global_score"), F.col("junction_mean"), F.col("junction_min"))))
    return scored.orderBy(F.col("student_rank_score").desc_nulls_last(), "combo_compact", "doc_id").limit(k)


@query(f"WITH {_TOP} SELECT doc_id, combo_compact, round(student_rank_score, 6) AS student_rank_score FROM top")
def rank_score_topk(spark, d):
    return shortlist(spark, d).select("doc_id", "combo_compact", F.round("student_rank_score", 6).alias("student_rank_score"))


@query(f"""WITH {V_LIB}, m AS (SELECT map_from_entries(list((letter || slot, round(weight * 10000)::BIGINT))) AS m FROM v_lib),
s AS (SELECT range AS idx, {COMBO.format('range')} AS combo_compact FROM range(4194304))
SELECT idx, combo_compact, list_sum(list_transform(range(1, 12), lambda i: m[substr(combo_compact, i::INT, 1) || i]))::BIGINT AS score FROM s, m ORDER BY score DESC, combo_compact LIMIT 50""")
def exhaustive_topk(spark, d):
    """All designs scored by the mean prices of their fragments, over all of part; the best fifty."""
    return ranking.exhaustive(spark, _weights(spark, d), 50)


def _weights(spark, d):
    """One row with the prices of the fragments by slot and letter."""
    place = (F.col("slot") - 1) * len(combos.ALPHABET) + F.instr(F.lit(combos.ALPHABET), F.col("letter"))
    pairs = parts(spark, d).select(F.struct(place.alias("k"), F.round(F.col("weight") * 10000).cast("long").alias("w")).alias("x"))
    return pairs.limit(combos.SLOTS * len(combos.ALPHABET)).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]).alias("w"))


@query(f"WITH {_TOP} SELECT doc_id, row_number() OVER (ORDER BY student_rank_score DESC NULLS LAST, combo_compact)::INT AS final_rank FROM top")
def final_rank(spark, d):
    return ranking.final_rank(shortlist(spark, d), "student_rank_score").select("doc_id", "final_rank")


@query(f"""WITH RECURSIVE {_TOP}, o AS (SELECT combo_compact, student_rank_score, row_number() OVER (ORDER BY student_rank_score DESC NULLS LAST, combo_compact) AS n FROM top),
g AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS acc UNION ALL SELECT o.n, CASE WHEN len(acc) < 20 AND len(list_filter(acc, lambda y: hamming(y, o.combo_compact) < 8)) = 0 THEN list_append(acc, o.combo_compact) ELSE acc END FROM g JOIN o ON o.n = g.n + 1)
, a AS (SELECT acc FROM g ORDER BY n DESC LIMIT 1), p AS (SELECT combo_compact, n, list_contains(acc, combo_compact) AS far FROM o, a)
SELECT combo_compact, CASE WHEN far THEN 'distance' ELSE 'backfill' END AS selection_reason FROM p ORDER BY NOT far, n LIMIT 20""")
def greedy_diversity(spark, d):
    return ranking.greedy_diversity(shortlist(spark, d).select("combo_compact", "student_rank_score"), 20, "student_rank_score", least=8).select("combo_compact", "selection_reason")


@query()
def diverse_exhaustive(spark, d):
    """Of all designs, by the mean prices of their fragments over part, the best fifty that differ in four slots at least."""
    return ranking.diverse(ranking.weighted(spark, _weights(spark, d)), 50, least=4).select("idx", "score", "selection_order")


@query(f"WITH {_TOP} SELECT v_lab.doc_id, v_lab.combo_compact IN (SELECT combo_compact FROM top) AS diversity_selected FROM v_lab")
def diversity_flag_semi(spark, d):
    return ranking.flagged(features(spark, d), shortlist(spark, d)).select("doc_id", "diversity_selected")


@query(f"WITH {V_LAB}, {V_COMBO} SELECT o_orderkey, combo AS combo_compact FROM v_combo WHERE combo NOT IN (SELECT combo_compact FROM v_lab WHERE label = 1)")
def background_anti(spark, d):
    return calibration.background_only(designs(spark, d).select("o_orderkey", F.col("combo").alias("combo_compact")), features(spark, d).where("label = 1"))


@query(f"WITH {V_LAB}, {V_COMBO} SELECT combo_compact FROM v_lab UNION SELECT combo FROM v_combo")
def union_distinct(spark, d):
    return features(spark, d).select("combo_compact").union(designs(spark, d).select("combo")).distinct()


@query(f"WITH {V_LAB} SELECT doc_id, combo_compact, 1 AS label, NULL::BIGINT AS o_orderkey FROM v_lab WHERE label = 1 UNION ALL SELECT NULL, combo, 0, o_orderkey FROM ({'WITH ' + V_COMBO} SELECT * FROM v_combo)")
def label_union(spark, d):
    active = features(spark, d).where("label = 1").select("doc_id", "combo_compact")
    return calibration.labelled(active, designs(spark, d).select("o_orderkey", F.col("combo").alias("combo_compact"))).select("doc_id", "combo_compact", "label", "o_orderkey")


@query(f"WITH {V_LAB} SELECT label, round(quantile_cont(junction_min, 0.1) FILTER (NOT isnan(junction_min)), 6) AS s_min FROM v_lab GROUP BY label")
def s_min_quantile(spark, d):
    return calibration.s_min_grouped(features(spark, d), "label").select("label", F.round("s_min", 6).alias("s_min"))


@query(f"""WITH {V_LAB} SELECT label, round(avg(global_score), 6) AS global_score, round(avg(junction_mean), 6) AS junction_mean, round(avg(junction_min) FILTER (NOT isnan(junction_min)), 6) AS junction_min, count(*) AS n FROM v_lab GROUP BY label""")
def class_feature_means(spark, d):
    rows = calibration.feature_means(features(spark, d))
    return rows.select("label", *[F.round(c, 6).alias(c) for c in calibration.FEATURES], "n")


_A = ARTIFACT["coefficients"]


@query(f"""WITH {V_LAB} SELECT doc_id, round(1 / (1 + exp(-({ARTIFACT['intercept']}::DOUBLE + {_A[0]}::DOUBLE * global_score + {_A[1]}::DOUBLE * junction_mean + {_A[2]}::DOUBLE * junction_min))), 6) AS calibrated_prob,
  junction_min >= {ARTIFACT['s_min_threshold']}::DOUBLE AND NOT isnan(junction_min) AS passes_s_min FROM v_lab WHERE NOT isnan(junction_min)""")
def apply_calibration(spark, d):
    return calibration.apply(features(spark, d).where("not isnan(junction_min)"), ARTIFACT).select("doc_id", F.round("calibrated_prob", 6).alias("calibrated_prob"), "passes_s_min")


@query(f"WITH {V_LAB} SELECT doc_id, NOT isnan(junction_min) AND junction_min >= -50 AS passes_s_min, true AS without_threshold FROM v_lab")
def passes_s_min(spark, d):
    return features(spark, d).select("doc_id", calibration.passes(F.col("junction_min"), -50.0).alias("passes_s_min"), calibration.passes(F.col("junction_min"), float("nan")).alias("without_threshold"))


@query()
def fit_calibrator(spark, d):
    """The calibration fitted to labelled documents and applied to them."""
    rows = features(spark, d).where("not isnan(junction_min)")
    return calibration.apply(rows, calibration.fit(rows.where("label = 1"), rows.where("label = 0"))).select("doc_id", "label", "calibrated_prob", "passes_s_min")


@query(f"""WITH {V_LAB} SELECT count(*) AS n, round(corr(junction_mean, junction_min), 6) AS corr, round(avg(abs(junction_mean - junction_min)), 6) AS mae, round(avg((junction_mean - junction_min) ** 2), 6) AS mse FROM v_lab WHERE NOT isnan(junction_min)""")
def regression_metrics(spark, d):
    return reports.regression_metrics(features(spark, d), "junction_mean", "junction_min").select("n", *[F.round(c, 6).alias(c) for c in ("corr", "mae", "mse")])


@query("""SELECT epoch, round(loss, 6) AS loss FROM (SELECT o_orderkey % 50 AS epoch, avg(loss) AS loss FROM (SELECT o_orderkey, avg(l_discount) AS loss FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1)""")
def epoch_means(spark, d):
    batches = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.avg("l_discount").alias("loss"))
    return reports.epoch_means(batches.withColumn("epoch", F.col("o_orderkey") % 50), "loss").select("epoch", F.round("loss", 6).alias("loss"))


@query("SELECT epoch, val_loss FROM (SELECT doc_id AS epoch, n_chars::DOUBLE AS val_loss FROM documents) ORDER BY val_loss, epoch LIMIT 1")
def best_epoch(spark, d):
    return reports.best_epoch(table(spark, d, "documents").select(F.col("doc_id").alias("epoch"), F.col("n_chars").cast("double").alias("val_loss")))


@query(f"""WITH {V_COMBO} SELECT i::INT AS slot, {', '.join(f"round(count(*) FILTER (substr(combo, i::INT, 1) = '{c}') / count(*), 6) AS {c}" for c in 'ALFM')} FROM v_combo, range(1, 12) s(i) GROUP BY i""")
def slot_letter_pivot(spark, d):
    return reports.slot_frequencies(designs(spark, d), "combo").select("slot", *[F.round(c, 6).alias(c) for c in combos.ALPHABET])


_LISTS = f"""{V_LAB}, a AS (SELECT combo_compact, row_number() OVER (ORDER BY global_score DESC, combo_compact) AS rank FROM v_lab), b AS (SELECT combo_compact, row_number() OVER (ORDER BY junction_mean DESC, combo_compact) AS rank FROM v_lab)"""


@query(f"""WITH {_LISTS}, m AS (SELECT greatest(a.rank, b.rank) AS k FROM a JOIN b USING (combo_compact)) SELECT k::INT AS k, round((SELECT count(*) FROM m WHERE m.k <= s.k) / k, 6) AS overlap FROM range(1, 51) s(k) WHERE k <= (SELECT max(rank) FROM a)""")
def topk_overlap_curve(spark, d):
    rows = features(spark, d).select("combo_compact", "global_score", "junction_mean")
    a, b = (reports.rank_curve(rows, 50, c) for c in ("global_score", "junction_mean"))
    return reports.overlap_curve(a, b, 50).select("k", F.round("overlap", 6).alias("overlap"))


@query(f"WITH {_LISTS} SELECT rank::INT AS rank, combo_compact FROM a WHERE rank <= 50")
def rank_score_curve(spark, d):
    return reports.rank_curve(features(spark, d), 50, "global_score").select("rank", "combo_compact")


# candidates and the library


_ORDER = "PARTITION BY parent, slot ORDER BY adjusted_score DESC, gen_idx"


@query(f"WITH {V_CAND} SELECT parent, slot, gen_idx, adjusted_score FROM v_cand QUALIFY row_number() OVER ({_ORDER}) = 1")
def best_per_group(spark, d):
    return library.best(candidates(spark, d)).select("parent", "slot", "gen_idx", "adjusted_score")


@query(f"WITH {V_CAND} SELECT parent, slot, gen_idx, row_number() OVER ({_ORDER})::INT AS rank FROM v_cand QUALIFY rank <= 3")
def topn_per_group(spark, d):
    return library.top(candidates(spark, d), 3).select("parent", "slot", "gen_idx", "rank")


@query(f"""WITH {V_CAND} SELECT parent, slot, gen_idx, coalesce(adjusted_score - lead(adjusted_score) OVER ({_ORDER}) < 25, false) AS ambiguous FROM v_cand QUALIFY row_number() OVER ({_ORDER}) = 1""")
def ambiguity_lead(spark, d):
    return library.ambiguous(candidates(spark, d)).select("parent", "slot", "gen_idx", "ambiguous")


@query(f"WITH {V_CAND} SELECT gen_idx, parent, slot, stop_count FROM v_cand QUALIFY stop_count <= 0 OR min(stop_count) OVER (PARTITION BY parent, slot) > 0")
def stop_filter_fallback(spark, d):
    return library.within_stops(candidates(spark, d)).select("gen_idx", "parent", "slot", "stop_count")


@query(f"""WITH {V_CAND}, b AS (SELECT * FROM v_cand QUALIFY row_number() OVER ({_ORDER}) = 1), l AS (SELECT parent, parent_start >= lag(parent_end, 1, -1) OVER (PARTITION BY parent ORDER BY slot) - 5 AS ok FROM b)
SELECT parent, bool_and(ok) AS slots_increasing FROM l GROUP BY parent""")
def slots_increasing(spark, d):
    return library.slots_increasing(library.best(candidates(spark, d)))


_SENTINEL = "{'score': -1e300::DOUBLE, 'stop': -1000000::INT, 'path': []::BIGINT[]}"


def _chain(source: str, keep: int) -> str:
    """SQL of the chains of candidates: the states of a parent's slot are a list, a step makes the next from it."""
    best = lambda xs: f"list_reduce(list_concat([{_SENTINEL}], {xs}), lambda a, b: CASE WHEN b.score > a.score THEN b ELSE a END)"
    before = best("list_filter(st, lambda s: c.b >= s.stop - 5)")
    return f"""r AS (SELECT *, row_number() OVER ({_ORDER}) AS rk FROM {source} QUALIFY rk <= {keep}),
o AS (SELECT parent, slot, list({{'g': gen_idx::BIGINT, 's': adjusted_score::DOUBLE, 'b': parent_start, 'e': parent_end}} ORDER BY rk) AS opts FROM r GROUP BY parent, slot),
q AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY slot) AS k, count(*) OVER (PARTITION BY parent) AS n FROM o),
f AS (SELECT parent, k, n, list_transform(opts, lambda c: {{'score': c.s, 'stop': c.e, 'path': [c.g]}}) AS st FROM q WHERE k = 1
  UNION ALL SELECT f.parent, q.k, f.n, list_filter(list_transform(opts, lambda c: {{'score': {before}.score + c.s, 'stop': c.e, 'path': CASE WHEN len({before}.path) > 0 THEN list_append({before}.path, c.g) ELSE []::BIGINT[] END}}), lambda s: len(s.path) > 0) FROM f JOIN q ON q.parent = f.parent AND q.k = f.k + 1),
e AS (SELECT parent, {best('st')}.path AS path FROM f WHERE k = n),
ch AS (SELECT q.parent, q.slot, CASE WHEN len(path) > 0 THEN path[q.k] ELSE opts[1].g END AS gen_idx, len(path) = 0 AS fell_back FROM q JOIN e USING (parent))"""


@query(f"WITH RECURSIVE {V_CAND}, {_chain('v_cand', 3)} SELECT ch.parent, ch.slot, ch.gen_idx, adjusted_score, fell_back FROM ch JOIN v_cand USING (gen_idx)")
def chain_dp(spark, d):
    return library.chain(candidates(spark, d)).select("parent", "slot", "gen_idx", "adjusted_score", "fell_back")


@query(f"""WITH RECURSIVE {V_CAND}, kept AS (SELECT * FROM v_cand QUALIFY stop_count <= 0 OR min(stop_count) OVER (PARTITION BY parent, slot) > 0), {_chain('kept', 5)},
am AS (SELECT parent, slot, coalesce(adjusted_score - lead(adjusted_score) OVER ({_ORDER}) < 25, false) AS ambiguous FROM kept QUALIFY row_number() OVER ({_ORDER}) = 1),
rows_ AS (SELECT ch.parent, ch.slot, ch.gen_idx, adjusted_score, fell_back, ambiguous, parent_start, parent_end, concat_ws(';', CASE WHEN ambiguous THEN 'ambiguous_top2' END, CASE WHEN stop_count > 0 THEN 'stop_in_trimmed' END) AS warnings FROM ch JOIN v_cand USING (gen_idx) JOIN am ON am.parent = ch.parent AND am.slot = ch.slot),
inc AS (SELECT parent, bool_and(ok) AS slots_increasing FROM (SELECT parent, parent_start >= lag(parent_end, 1, -1) OVER (PARTITION BY parent ORDER BY slot) - 5 AS ok FROM rows_) GROUP BY parent)
SELECT parent, slot, gen_idx, adjusted_score, fell_back, ambiguous, warnings, slots_increasing FROM rows_ JOIN inc USING (parent)""")
def library_build(spark, d):
    """The library job's choice over all candidates: stop filter, chains, ambiguity, warnings, order of slots."""
    rows = fragment_library.warned(fragment_library.chosen(candidates(spark, d)).withColumn("x_fraction", F.lit(0.0)))
    return rows.join(library.slots_increasing(rows), "parent").select("parent", "slot", "gen_idx", "adjusted_score", "fell_back", "ambiguous", "warnings", "slots_increasing")


_CUT = "CASE WHEN o_orderkey % 7 = {k} THEN '?' ELSE lower(substr(combo, {i}, 1)) || ' ' END"
_WIDE = ", ".join(f"{_CUT.format(k=i % 7, i=i)} AS s{i:02d}" for i in range(1, 12))


@query(f"WITH {V_COMBO}, w AS (SELECT o_orderkey, combo, {_WIDE} FROM v_combo WHERE o_orderkey % 3 > 0 OR o_orderkey % 7 > 0) SELECT o_orderkey, combo AS combo_compact FROM w WHERE " + " AND ".join(f"upper(trim(s{i:02d})) IN ('A', 'L', 'F', 'M')" for i in range(1, 12)) + f" UNION ALL SELECT o_orderkey, combo FROM ({'WITH ' + V_COMBO} SELECT * FROM v_combo) WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 = 0")
def active_row_filter(spark, d):
    rows = designs(spark, d)
    slots = [f"s{i:02d}" for i in range(1, 12)]
    wide = rows.select(*[F.expr(f"CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 = 0 THEN substr(combo, {i}, 1) ELSE {_CUT.format(k=i % 7, i=i)} END").alias(f"s{i:02d}") for i in range(1, 12)], "o_orderkey")
    return library.with_combo(library.active_rows(wide), slots).select("o_orderkey", "combo_compact")


@query("""SELECT c_custkey, ['As','Fn','Lb','Mb2'][(c_custkey % 4 + 1)::INT] AS parent, (c_custkey % 100)::INT AS slot FROM customer""")
def filename_parse(spark, d):
    name = F.concat(F.lit("/x/"), F.element_at(F.array(*[F.lit(x) for x in ("As", "fn", "LB", "Mb")]), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit("_"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit(".DNA"))
    return table(spark, d, "customer").select("c_custkey", fragment_name(name).alias("f")).select("c_custkey", "f.parent", "f.slot")


# memo, models


_MEMO = """memo AS (SELECT 'k' || (event_id % 3000) AS key, value AS global_score, epoch(ts)::BIGINT AS created_at, event_id FROM events),
latest AS (SELECT * FROM memo QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, lpad(event_id::VARCHAR, 12, '0') DESC) = 1)"""


def memo_rows(spark, d):
    at = F.unix_timestamp(F.date_trunc("second", "ts")).cast("double")
    return table(spark, d, "events").select(F.concat(F.lit("k"), (F.col("event_id") % 3000).cast("string")).alias("key"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("seq_hash"), F.col("value").alias("global_score"), F.array(F.col("value")).alias("junction_scores"), at.alias("created_at"))


@query(f"WITH {_MEMO} SELECT key, global_score FROM latest")
def memo_upsert_latest(spark, d):
    return memo.latest(memo_rows(spark, d)).select("key", "global_score")


@query(f"WITH {_MEMO} SELECT o_orderkey, latest.key IS NOT NULL AS teacher_cache_hit, coalesce(global_score, -1.0::DOUBLE) AS global_score FROM orders LEFT JOIN latest ON latest.key = 'k' || (o_orderkey % 5000)")
def memo_hit_miss(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("k"), (F.col("o_orderkey") % 5000).cast("string")).alias("key"))
    fresh = lambda df: df.withColumn("global_score", F.lit(-1.0)).withColumn("junction_scores", F.array(F.lit(-1.0)))
    return memo.scored(rows, memo_rows(spark, d), fresh).select("o_orderkey", "teacher_cache_hit", "global_score")


@query(SQL["memo_hit_miss"])
def memo_bucketed(spark, d):
    """The lookups of memo_hit_miss in a memo on disk that two appends made; the memo goes, the result stays in the shared folder."""
    folder = f"{scratch(spark)}/memo-{uuid.uuid4().hex}"
    made = memo_rows(spark, d).withColumn("seq_len", F.lit(0)).withColumn("meta", F.lit("{}"))
    odd = F.substring("seq_hash", -1, 1).isin(*"13579")
    for part in (made.where(odd), made.where(~odd)):
        memo.append(f"{folder}/memo", part)
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("k"), (F.col("o_orderkey") % 5000).cast("string")).alias("key"))
    fresh = lambda df: df.withColumn("global_score", F.lit(-1.0)).withColumn("junction_scores", F.array(F.lit(-1.0)))
    memo.scored(rows, memo.lookup(rows, f"{folder}/memo"), fresh).select("o_orderkey", "teacher_cache_hit", "global_score").write.parquet(f"{folder}/out")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/memo")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.read.parquet(f"{folder}/out")


_PAIRS = """pairs AS (SELECT CASE WHEN i = 1 THEN '^' ELSE substr(s, (i - 1)::INT, 1) END AS prev, substr(s, i::INT, 1) AS cur FROM (SELECT upper(replace(p_name, ' ', '')) AS s FROM part), range(1, 60) r(i) WHERE i <= length(s)),
model AS (SELECT prev, cur, count(*) AS n, ln((count(*) + 1) / (sum(count(*)) OVER (PARTITION BY prev) + 28)) AS ll FROM pairs GROUP BY prev, cur)"""


def names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence_aa"))


@query(f"WITH {_PAIRS} SELECT prev, cur, n, round(ll, 6) AS ll FROM model")
def bigram_lm_fit(spark, d):
    return scorers.bigram_fit(names(spark, d)).select("prev", "cur", "n", F.round("ll", 6).alias("ll"))


@query(f"""WITH {_PAIRS} SELECT p_partkey, round(avg(ll), 6) AS global_score FROM (SELECT p_partkey, CASE WHEN i = 1 THEN '^' ELSE substr(s, (i - 1)::INT, 1) END AS prev, substr(s, i::INT, 1) AS cur
  FROM (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS s FROM part), range(1, 60) r(i) WHERE i <= length(s)) JOIN model USING (prev, cur) GROUP BY p_partkey""")
def bigram_score(spark, d):
    rows = names(spark, d)
    return scorers.bigram_scorer(scorers.bigram_fit(rows))(rows).select("p_partkey", F.round(junctions.global_score(F.col("token_ll")), 6).alias("global_score"))


@query(f"""WITH {V_COMBO}, h AS (SELECT o_orderkey, ('0x' || substr(md5('13:' || combo), 1, 15))::BIGINT AS h, combo FROM v_combo)
SELECT o_orderkey, row_number() OVER (ORDER BY h % 65536, h, combo) <= (SELECT greatest(1, least(count(*) - 1, round(count(*) * 0.2))) FROM h) AS is_val FROM h""")
def split_rows(spark, d):
    return sampling.split(designs(spark, d), 0.2, 13, "combo").select("o_orderkey", "is_val")


#: Scores of the designs d by the letter-pair model of the library.
_PAIR_SCORES = f"""mp AS (SELECT CASE WHEN i = 1 THEN '^' ELSE substr(seq, (i - 1)::INT, 1) END AS prev, substr(seq, i::INT, 1) AS cur FROM v_lib, range(1, 200) r(i) WHERE i <= length(seq)),
model AS (SELECT prev || cur AS p, ln((count(*) + 1) / (sum(count(*)) OVER (PARTITION BY prev) + 28)) AS ll FROM mp GROUP BY prev, cur), mm AS (SELECT map(list(p), list(ll)) AS m FROM model),
bs AS (SELECT combo, string_agg(seq, '' ORDER BY slot) AS seq, list(length(seq)::INT ORDER BY slot) AS lens FROM d, v_lib WHERE letter = substr(combo, slot, 1) GROUP BY combo),
ts AS (SELECT combo, seq, list_transform(range(1, 11), lambda i: list_sum(list_slice(lens, 1, i))::INT) AS bounds, list_transform(range(1, length(seq) + 1), lambda i: coalesce(m[CASE WHEN i = 1 THEN '^' || substr(seq, 1, 1) ELSE substr(seq, (i - 1)::INT, 2) END], -8.0::DOUBLE)) AS ll FROM bs, mm),
js AS (SELECT combo, seq, list_avg(ll) AS global_score, list_transform(bounds, lambda b: list_avg(list_slice(ll, greatest(b - 25, 1) + 1, least(length(seq)::INT, b + 25)))) AS j FROM ts),
ss AS (SELECT combo, seq, global_score, list_avg(j) AS junction_mean, list_min(j) AS junction_min, j[1] AS junction_01, j[10] AS junction_10 FROM js)"""
_RANKED = f"""{V_COMBO}, {V_LIB}, d AS (SELECT DISTINCT combo FROM v_combo), {_PAIR_SCORES},
short AS (SELECT * FROM ss ORDER BY global_score + 0.5::DOUBLE * junction_mean + 0.5::DOUBLE * junction_min DESC, combo LIMIT 500),
cal AS (SELECT *, 1 / (1 + exp(-({ARTIFACT['intercept']}::DOUBLE + {_A[0]}::DOUBLE * global_score + {_A[1]}::DOUBLE * junction_mean + {_A[2]}::DOUBLE * junction_min))) AS prob FROM short),
o AS (SELECT *, row_number() OVER (ORDER BY prob DESC, combo) AS n FROM cal),
g AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS acc UNION ALL SELECT o.n, CASE WHEN len(acc) < 50 AND len(list_filter(acc, lambda y: hamming(y, o.combo) < 2)) = 0 THEN list_append(acc, o.combo) ELSE acc END FROM g JOIN o ON o.n = g.n + 1),
a AS (SELECT acc FROM g ORDER BY n DESC LIMIT 1), p AS (SELECT o.* FROM o, a ORDER BY NOT list_contains(acc, combo), n LIMIT 50)"""


@query(f"""WITH RECURSIVE {_RANKED} SELECT row_number() OVER (ORDER BY prob DESC, combo)::INT AS final_rank, combo AS combo_compact, seq AS sequence_aa, sha256(seq) AS sequence_hash,
  round(global_score, 6) AS global_score, round(junction_mean, 6) AS junction_mean, round(junction_min, 6) AS junction_min, round(ln(prob), 6) AS log_prob, junction_min >= {ARTIFACT['s_min_threshold']}::DOUBLE AS passes_s_min,
  round(junction_01, 6) AS junction_01, round(junction_10, 6) AS junction_10, 'r1' AS source_run_id, 13::BIGINT AS seed FROM p""")
def rank_candidates(spark, d):
    """The flagship: designs of all orders scored, cut to a shortlist, rescored, calibrated, diversified, ranked."""
    out = rank(designs(spark, d).select("idx", F.col("combo").alias("combo_compact")).distinct(), parts(spark, d), ARTIFACT, run_id="r1", seed=13)
    rounded = [F.round(c, 6).alias(c) for c in ("global_score", "junction_mean", "junction_min", "junction_01", "junction_10")]
    return out.select("final_rank", "combo_compact", "sequence_aa", "sequence_hash", *rounded, F.round(F.log("calibrated_prob"), 6).alias("log_prob"), "passes_s_min", "source_run_id", "seed")


@query()
def rank_exhaustive(spark, d):
    """All 4 ** 11 designs over the fragments of part, ranked."""
    return rank(ranking.enumerated(spark), parts(spark, d), ARTIFACT, run_id="all", seed=0)


def pair_scorer(spark, d):
    return scorers.bigram_scorer(scorers.bigram_fit(parts(spark, d), "aa_sequence"))


@query(f"""WITH {V_COMBO}, {V_LAB}, {V_LIB}, d AS (SELECT combo FROM v_combo UNION SELECT combo_compact FROM v_lab WHERE label = 1), {_PAIR_SCORES}
SELECT 'distill' AS source_run_id, 13::BIGINT AS seed, combo AS combo_compact, sha256(seq) AS sequence_hash, round(global_score, 6) AS global_score, round(junction_mean, 6) AS junction_mean, round(junction_min, 6) AS junction_min, round(junction_01, 6) AS junction_01, false AS teacher_cache_hit FROM ss""")
def distill_build(spark, d):
    """The distillation set of the designs of all orders and of the active ones."""
    sample, active = designs(spark, d).select(F.col("combo").alias("combo_compact")), features(spark, d).where("label = 1")
    out = distill(sample, active, parts(spark, d), pair_scorer(spark, d), run_id="distill", seed=13)
    return out.select("source_run_id", "seed", "combo_compact", "sequence_hash", *[F.round(c, 6).alias(c) for c in ("global_score", "junction_mean", "junction_min", "junction_01")], "teacher_cache_hit")


#: Rows that the student learns from, those with the smallest hashes of their keys.
TAUGHT = 512


def student(spark, d, folder: str) -> DataFrame:
    """The history of a small student of the distillation set of all orders; folder gets its checkpoints."""
    sample = designs(spark, d).select(F.col("combo").alias("combo_compact"))
    taught = distill(sampling.hashed_sample(sample.distinct(), TAUGHT, 13), None, parts(spark, d), pair_scorer(spark, d))
    return train.train(spark, taught, folder, parts(spark, d), training.Shape(16, 24, 1, 0.0), train.Settings(batch=64, epochs=3, rate=0.02, lanes=2))


@query()
def student_scores(spark, d):
    """All orders' designs scored by the best checkpoint of a student trained on TAUGHT of them, beside the teacher's scores."""
    folder = f"{scratch(spark)}/student-{uuid.uuid4().hex}"
    student(spark, d, folder)
    rows = library.built(designs(spark, d).select(F.col("combo").alias("combo_compact")).distinct(), parts(spark, d))
    names = ("global_score", "junction_mean", "junction_min")
    own = scorers.summaries(weights.saved_scorer(spark, f"{folder}/best")(rows)).select("combo_compact", "sequence_aa", "domain_lengths", *[F.round(c, 6).alias(f"student_{c}") for c in names])
    return scorers.summaries(pair_scorer(spark, d)(own)).select("combo_compact", *[f"student_{c}" for c in names], *[F.round(c, 6).alias(f"teacher_{c}") for c in names])


@query(f"""WITH {V_COMBO}, {V_LAB}, {V_LIB}, act AS (SELECT DISTINCT combo_compact FROM v_lab WHERE label = 1), d AS (SELECT DISTINCT combo FROM v_combo WHERE combo NOT IN (SELECT combo_compact FROM act) UNION SELECT combo_compact FROM act), {_PAIR_SCORES}
SELECT combo AS combo_compact, (combo IN (SELECT combo_compact FROM act))::INT AS label, round(global_score, 6) AS global_score, round(junction_mean, 6) AS junction_mean, round(junction_min, 6) AS junction_min,
  junction_min >= (SELECT quantile_cont(junction_min, 0.1) FROM ss WHERE combo IN (SELECT combo_compact FROM act)) - 1e-9 AS passes_s_min FROM ss""")
def calibrate_background(spark, d):
    """The calibration job over the active designs and those of all other orders: scored, fitted, saved, read back, applied."""
    active = features(spark, d).where("label = 1").select("combo_compact").distinct()
    background = designs(spark, d).select(F.col("combo").alias("combo_compact")).distinct()
    _, both = calibrate(spark, active, background, parts(spark, d), pair_scorer(spark, d), f"{scratch(spark)}/calibrate-{uuid.uuid4().hex}", size=0)
    return both.select("combo_compact", "label", *[F.round(c, 6).alias(c) for c in calibration.FEATURES], "passes_s_min")
