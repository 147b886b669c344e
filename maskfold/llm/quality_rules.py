"""Quality rules whose limits follow the data.

Each document gets whole-text counts. A limit for each measure is read from a mergeable quantile
sketch of its language and source: a histogram over integers with 32 buckets to a power of two
(relative error below 1/32). Sketches merge by adding counts, so they are made by a plain grouped
count in two steps. The quartiles of a group are drawn towards those of its language by ``PRIOR`` documents, and
those of a language towards the corpus's: the fewer documents, the more, without a step at any size.

Texts are scanned once: the counts are written to the shared folder, and both the sketches and the verdicts are read from there.

Defined results: a null or empty text has no words, fails the base rule and is not kept; very long texts are counted
whole; null languages and sources are groups of their own; repeated rows are judged alike, and a value that equals its
limit passes; an empty table gives an empty result; other columns are carried under numbers of our own, so
no name clashes, and one that has the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textkit as tk
from .common import boxed, lookup, saved, scan, table, unboxed

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bangs")
WINDOW = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BANGS = np.zeros(256, bool)
_BANGS[list(b"!?")] = True

#: Measures in thousandths, the spread that a group is granted at least, and the sides that are limited.
MEASURES = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", 10, "high"),
    "upper": ("1000 * n_upper div greatest(n_upper + n_lower, 1)", 40, "high"),
    "bangs": ("1000 * n_bangs div greatest(n_words, 1)", 20, "high"),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 50, "high"),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 150, "high"),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 60, "both"),
}
FENCE = 4  # spreads beyond the quartiles
PRIOR = 50  # documents of the wider group that each quartile is drawn towards
MAX_REPEAT_PERCENT = 20
MIN_WORDS = 10


def count_batch(text: pa.Array) -> dict[str, np.ndarray]:
    """The counts of :data:`COUNTS` for each text of an Arrow column."""
    data, at = tk.utf8(text)
    parts = [_count_slice(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in tk.slices(at)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in COUNTS}


def _count_slice(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    docs = len(at) - 1
    each = lambda flags: np.diff(tk.counts_before(flags)[at])
    inside = tk.NOT_SPACE[data]
    start, end, doc = tk.word_spans(data, at, tk.NOT_SPACE)
    out = {
        "n_words": np.bincount(doc, minlength=docs),
        "word_chars": each(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": each(_SYMBOLS[data]),
        "n_upper": each((data >= 0x41) & (data <= 0x5A)),
        "n_lower": each((data >= 0x61) & (data <= 0x7A)),
        "n_bangs": each(_BANGS[data]),
    }
    windows = tk.window_hash(tk.span_hash(data, start, end), WINDOW)
    ok = np.flatnonzero(tk.windows_inside(doc, WINDOW))
    twice = ok[tk.repeated(tk.keyed(doc[ok], windows[ok]))]
    out["n_repeat_words"] = np.bincount(doc[tk.covered(twice, WINDOW, len(doc))], minlength=docs)
    # lines: ended by \n or by the document
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.union1d(breaks + 1, at[:-1])
    starts = starts[starts < len(data)]
    of = np.searchsorted(at, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], at[of + 1])
    words = tk.counts_before(inside)
    has = words[ends] > words[starts]
    starts, ends, of = starts[has], ends[has], of[has]
    keys = np.unique(tk.keyed(of, tk.span_hash(data, starts, ends)), return_index=True)[1]
    out["n_lines"] = np.bincount(of, minlength=docs)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[keys], minlength=docs)
    return out


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the whole-text counts; a column that has one of their names is replaced."""
    docs = docs.drop(*COUNTS)
    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = count_batch(b.column(text))
            added = [pa.array(counts[c], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *COUNTS])

    return scan(docs, count, schema)


def _measures() -> list[Column]:
    return [F.expr(e).alias(k) for k, (e, _, _) in MEASURES.items()]


#: The bucket of integer v: its six leading bits, and how many bits follow them.
def _bucket(v: Column) -> Column:
    low = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (low * 64 + F.call_function("shiftright", v, low)).cast("int")


def _least(bucket: Column) -> Column:
    return F.call_function("shiftleft", F.pmod(bucket, F.lit(64)).cast("bigint"), F.expr("0") + F.floor(bucket / 64).cast("int"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _drawn(rows: str, own: str, wide: str, prior: int) -> Column:
    """A quartile of ``rows`` documents, drawn towards the wider group's."""
    return F.expr(f"({rows} * {own} + {prior} * {wide}) div ({rows} + {prior})")


def limits(counted: DataFrame, prior: int = PRIOR, fence: int = FENCE) -> DataFrame:
    """A row for each language and source with the least and most that each measure may be.

    Only documents that pass the base rule are sketched. ``counted`` is from :func:`with_counts`.
    """
    seen = counted.where(~base_failed()).select("lang", "source", *_measures())
    names = list(MEASURES)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), _bucket(F.col(k)).alias("bucket")) for i, k in enumerate(names)])).alias("p")
    cells = seen.select("lang", "source", pairs).groupBy("lang", "source", "p.m", "p.bucket").agg(F.count("*").alias("n"))
    cells = saved(cells, "sketches")

    def quartiles(by: list[str], name: str) -> DataFrame:
        merged = cells.groupBy(*by, "m", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "m")
        cum = merged.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
        found = cum.groupBy(*by, "m").agg(F.max("total").alias("rows"), _least(at(1)).alias("q1"), _least(at(3)).alias("q3"))
        return found.select(*[F.col(c).alias(f"_{c}") for c in (*by, "m")], *[F.col(c).alias(f"{name}_{c}") for c in ("rows", "q1", "q3")])

    out = cells.select("lang", "source", "m").distinct()
    for name, by in (("own", ["lang", "source"]), ("lang", ["lang"]), ("all", [])):
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "m")]
        out = out.join(quartiles(by, name), on, "left").drop(*[f"_{c}" for c in (*by, "m")])
    for q in ("q1", "q3"):
        out = out.withColumn(q, _drawn("lang_rows", f"lang_{q}", f"all_{q}", prior))
        out = out.withColumn(q, _drawn("own_rows", f"own_{q}", q, prior))
    spread = F.element_at(F.array(*[F.lit(s) for _, s, _ in MEASURES.values()]), F.col("m") + 1)
    reach = F.lit(fence) * F.greatest(F.col("q3") - F.col("q1"), spread)
    ends = out.select("lang", "source", "m", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    picked = [F.max(F.when(F.col("m") == i, F.col(side))).alias(f"{side}_{k}") for i, k in enumerate(names) for side in ("low", "high")]
    return ends.groupBy("lang", "source").agg(*picked)


def _judged(docs: DataFrame, prior: int, fence: int, carry_text: bool) -> DataFrame:
    """row, text (if carried), counts, base_failed and kept."""
    counted = with_counts(boxed(docs, "lang", "source"))
    counted = saved(counted if carry_text else counted.drop("text"), "counted")
    found = saved(limits(counted, prior, fence), "limits")
    joined = lookup(counted.withColumn("base_failed", base_failed()), found, ["lang", "source"])
    fine = F.lit(True)
    for k, (e, _, side) in MEASURES.items():
        fine &= F.expr(e) <= F.col(f"high_{k}")
        if side == "both":
            fine &= F.expr(e) >= F.col(f"low_{k}")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(True)))


def judge(docs: DataFrame, prior: int = PRIOR, fence: int = FENCE, carry_text: bool = True) -> DataFrame:
    """``docs`` (text, lang, source and others) with the counts, base_failed and kept; without the text unless it is carried."""
    added = (*COUNTS, "base_failed", "kept")
    return unboxed(_judged(docs, prior, fence, carry_text), docs, *added, without=added if carry_text else (*added, "text"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns and no others."""
    return unboxed(_judged(docs, PRIOR, FENCE, True).where("kept"), docs)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs, carry_text=False).select("doc_id", *COUNTS, "base_failed", "kept")


_MEASURE_SQL = ",\n  ".join(f"{e.replace(' div ', ' // ')} AS {k}" for k, (e, _, _) in MEASURES.items())
_UNPIVOT_SQL = "\n  UNION ALL ".join(f"SELECT lang, source, {i} AS m, {k} AS v FROM seen" for i, k in enumerate(MEASURES))
_SPREAD_SQL = "CASE m " + " ".join(f"WHEN {i} THEN {s}" for i, (_, s, _) in enumerate(MEASURES.values())) + " END"
_FINE_SQL = " AND ".join(f"{k} <= h{i}" + (f" AND {k} >= l{i}" if side == "both" else "") for i, (k, (_, _, side)) in enumerate(MEASURES.items()))
_PICK_SQL = ", ".join(f"max(CASE WHEN m = {i} THEN low END) AS l{i}, max(CASE WHEN m = {i} THEN high END) AS h{i}" for i in range(len(MEASURES)))


def _quartile_sql(name: str, by: str) -> str:
    part = f"{by}, m" if by else "m"
    return f"""{name} AS (
  SELECT {part}, max(total)::BIGINT AS n,
    min(CASE WHEN upto * 4 >= total THEN low_end END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN low_end END) AS q3
  FROM (SELECT {part}, low_end, sum(count(*)) OVER (PARTITION BY {part}) AS total,
      sum(count(*)) OVER (PARTITION BY {part} ORDER BY low_end) AS upto FROM cells GROUP BY {part}, low_end)
  GROUP BY {part})"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i : i + {WINDOW - 1}] AS five FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range({WINDOW}) AS x(k) GROUP BY r),
lines AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line),
ln AS (SELECT r, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup FROM lines GROUP BY r),
base AS (SELECT d.*, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup, 0) AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
  length(regexp_replace(t, '[^a-z]+', '', 'g'))::BIGINT AS n_lower,
  length(regexp_replace(t, '[^!?]+', '', 'g'))::BIGINT AS n_bangs
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  {_MEASURE_SQL} FROM base),
seen AS (SELECT * FROM judged WHERE NOT base_failed),
flat AS ({_UNPIVOT_SQL}),
cells AS (SELECT lang, source, m, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS low_end FROM flat),
{_quartile_sql('own', 'lang, source')},
{_quartile_sql('bylang', 'lang')},
{_quartile_sql('corpus', '')},
ql AS (SELECT b.lang, b.m, (b.n * b.q1 + {PRIOR} * c.q1) // (b.n + {PRIOR}) AS q1, (b.n * b.q3 + {PRIOR} * c.q3) // (b.n + {PRIOR}) AS q3
  FROM bylang b JOIN corpus c ON c.m = b.m),
q AS (SELECT o.lang, o.source, o.m, (o.n * o.q1 + {PRIOR} * l.q1) // (o.n + {PRIOR}) AS q1, (o.n * o.q3 + {PRIOR} * l.q3) // (o.n + {PRIOR}) AS q3
  FROM own o JOIN ql l ON l.m = o.m AND l.lang IS NOT DISTINCT FROM o.lang),
ends AS (SELECT lang, source, m, q1 - {FENCE} * greatest(q3 - q1, {_SPREAD_SQL}) AS low, q3 + {FENCE} * greatest(q3 - q1, {_SPREAD_SQL}) AS high FROM q),
lim AS (SELECT lang, source, {_PICK_SQL} FROM ends GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_lower, n_bangs, base_failed,
  NOT base_failed AND coalesce({_FINE_SQL}, true) AS kept
FROM judged j LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM j.lang AND lim.source IS NOT DISTINCT FROM j.source
"""
