"""Nucleotide and amino-acid strings as column functions."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "TCAG"
# The standard genetic code in the order of BASES, and the letters of the vocabulary.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
VOCABULARY = ("<pad>", "<bos>", *"ACDEFGHIKLMNPQRSTVWY", *"BJOUZ", "X")
PAD, BOS, UNKNOWN = 0, 1, len(VOCABULARY) - 1
STOP_PENALTY, X_PENALTY = 50.0, 5.0
SLOTS = 11


def codons() -> dict[str, str]:
    """Amino acid of each codon; one with N only where all that it can stand for agree."""
    plain = {"".join(c): CODE[k] for k, c in enumerate(itertools.product(BASES, repeat=3))}
    out = dict(plain)
    for c in itertools.product(BASES + "N", repeat=3):
        found = {plain["".join(x)] for x in itertools.product(*(BASES if b == "N" else b for b in c))}
        if len(found) == 1:
            out["".join(c)] = found.pop()
    return out


def longest_run(text: Column, least: int = 500) -> Column:
    """The longest run of A-Z and *, the first of equals; null if it is shorter than ``least``."""
    runs = F.regexp_extract_all(F.upper(text), F.lit("[A-Z*]+"), F.lit(0))
    best = F.array_max(F.transform(runs, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("k"), x.alias("run"))))
    return F.when(best["n"] >= least, best["run"])


def sanitised(dna: Column) -> Column:
    return F.regexp_replace(F.upper(dna), "[^ACGTN]", "")


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGTN", "TGCAN"))


def translated(dna: Column, frame: int | Column) -> Column:
    """Amino acids from frame 0, 1 or 2 on; stops stay as *, codons that are not clear become X."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    table = F.create_map(*[F.lit(x) for kv in codons().items() for x in kv])
    # one pass over the text; cutting each codon out of it would be one for each
    each = F.regexp_extract_all(F.substr(dna, frame + 1, F.length(dna)), F.lit("(?s)..."), F.lit(0))
    return F.array_join(F.transform(each, lambda c: F.coalesce(table[c], F.lit("X"))), "")


#: Bases that are translated together, at least those of one read.
TOGETHER = 1 << 20
_BASE = np.full(256, 5, np.uint8)
_BASE[list(b"TCAGN")] = range(5)
_PAIRED = np.array([BASES.index("A"), BASES.index("G"), BASES.index("T"), BASES.index("C"), 4, 5], np.uint8)
_AMINO = np.full(6**3, ord("X"), np.uint8)
for _c, _a in codons().items():
    _AMINO[[int(_BASE[ord(x)]) for x in _c] @ np.array([36, 6, 1])] = ord(_a)


def _frames(reads: list[bytes], reverse: bool) -> list[pa.Array]:
    """The amino acids of the frames, an array for each, of reads that lie one behind the other."""
    base = _BASE[np.frombuffer(b"".join(reads), np.uint8)]
    size = np.array([len(x) for x in reads], np.int64)
    first = np.cumsum(size) - size
    out = []
    for way in range(1 + reverse):
        x = _PAIRED[base] if way else base
        a, c = (x[2:], x[:-2]) if way else (x[:-2], x[2:])
        amino = _AMINO[36 * a + 6 * x[1:-1] + c] if len(x) > 2 else np.zeros(0, np.uint8)  # of the codon that begins there or, read backwards, ends there
        for f in range(3):
            n = np.maximum(size - f, 0) // 3
            ends = np.cumsum(n)
            k = np.arange(ends[-1]) - np.repeat(ends - n, n)
            at = np.repeat(first + size - 3 - f, n) - 3 * k if way else np.repeat(first + f, n) + 3 * k
            out.append(pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(amino[at])]))
    return out


def six_frames(dna: Column, reverse: bool = True) -> Column:
    """array<struct<gen_idx, orientation, frame, aa>> of the frames in the order in which ties are decided; each is translated() of its way."""
    many = 6 if reverse else 3

    @F.arrow_udf("array<string>")
    def frames(column: pa.Array) -> pa.Array:
        sent = [None if x is None else x.encode("ascii", "replace") for x in column.to_pylist()]
        parts, held = [[]], 0
        for x in sent:
            if held and held + len(x or b"") > TOGETHER:
                parts.append([])
                held = 0
            parts[-1].append(x)
            held += len(x or b"")
        out = []
        for part in parts:
            if part:
                own = [a.to_pylist() for a in _frames([x or b"" for x in part], reverse)]
                out += [[None] * many if x is None else list(r) for x, r in zip(part, zip(*own, strict=True), strict=True)]
        return pa.array(out, pa.list_(pa.string()))

    return F.transform(frames(dna), lambda aa, k: F.struct(k.alias("gen_idx"), F.when(k < 3, "fwd").otherwise("rev").alias("orientation"), (k % 3).alias("frame"), aa.alias("aa")))


def count_of(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def adjusted_score(score: Column, aa: Column) -> Column:
    return score - STOP_PENALTY * count_of(aa, "*") - X_PENALTY * count_of(aa, "X")


def x_fraction(aa: Column) -> Column:
    return F.when(F.length(aa) > 0, count_of(aa, "X") / F.length(aa)).otherwise(F.lit(1.0))


def without_stops(aa: Column) -> Column:
    return F.replace(aa, F.lit("*"), F.lit(""))


def trimmed(aa: Column, start: Column, end: Column) -> Column:
    """aa from start on, before end."""
    return F.substr(aa, start + 1, end - start)


def warnings(ambiguous: Column, stops: Column, x: Column, most_x: float = 0.10) -> Column:
    return F.concat_ws(";", F.when(ambiguous, "ambiguous_top2"), F.when(stops > 0, "stop_in_trimmed"), F.when(x > most_x, "high_X_fraction"))


def tokens(aa: Column) -> Column:
    """Vocabulary numbers; unknown letters are X."""
    numbers = F.create_map(*[F.lit(x) for k, t in enumerate(VOCABULARY) for x in (t, k)])
    return F.when(F.length(aa) > 0, F.transform(F.split(aa, ""), lambda c: F.coalesce(numbers[c], F.lit(UNKNOWN)))).otherwise(F.array().cast("array<int>"))


def detokenised(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.element_at(F.array(*[F.lit(t) for t in VOCABULARY]), i + 1)), "")


def shifted(ids: Column) -> Column:
    """The model's inputs for targets ids: the start symbol, then all but the last."""
    return F.when(F.size(ids) > 0, F.concat(F.array(F.lit(BOS)), F.slice(ids, F.lit(1), F.size(ids) - 1))).otherwise(F.raise_error(F.lit("empty sequence")).cast("array<int>"))


def uniform_split(length: Column, slots: int = SLOTS) -> Column:
    """Lengths of slots for a sequence of which they are not known: even, the rest in the last."""
    part = F.floor(length / slots).cast("int")
    return F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda i: F.when(i < slots, part).otherwise(length.cast("int") - (slots - 1) * part))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def spaced(text: Column, add: bool = True) -> Column:
    return F.array_join(F.split(text, ""), " ") if add else text


def cache_key(text: Column, lengths: Column, model: str, spaces: bool = False, most: int = 1024, left: int = 25, right: int = 25) -> Column:
    """The memo's key: settings, the hash of the sequence cut to ``most`` letters, and of the slot lengths.

    The lengths decide where the junctions lie, so they are part of the key.
    """
    return F.concat_ws("|", F.lit("lm"), F.lit(model), F.lit(f"spaces={int(spaces)}"), F.lit(f"maxlen={most}"), F.lit(f"wL={left}"), F.lit(f"wR={right}"),
                       sha256(F.substring(text, 1, most)), sha256(F.concat_ws(",", lengths.cast("array<string>"))))


def number_or_nan(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(float("nan")))


def is_letter(value: Column, allowed: str = "ALFM") -> Column:
    return F.coalesce(F.upper(F.trim(value)).isin(*allowed), F.lit(False))
