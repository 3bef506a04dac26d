"""Line dedup: later copies of repeated runs of lines are deleted.

A suffix array over the documents' line-ID sequences is built by distributed prefix doubling. Lines
that occur once can be in no repeated run and end every suffix before them; the others get IDs in
sorted order. A doubling step joins each suffix with the one ``depth`` lines on and ranks the pairs
by a range-partitioned sort, so that ranks are the order of suffixes by their first 2 * depth lines;
suffixes alone with their pair leave the array, and doubling ends when none is left.

Suffixes of equal rank are an interval. One whose suffixes do not all go on together to the next depth
is open there: its longest common prefix lies between depth and 2 * depth and is found from the earlier
ranks, by halving steps that all its suffixes must take. These are the longest-common-prefix intervals:
a run of that many lines, with all its copies; every run that repeats lies in one (``repeated_runs``).
All but an interval's first suffix, by doc_id and line, are later copies, and their lines are deleted if
the run has ``min_lines`` lines or, a single line, ``LONG`` words.

Blank lines are no part of the sequences and are kept. Edge cases: a null text stays null and has no
lines; repeated rows are later copies and become empty texts, not dropped rows; documents with equal
or null doc_id are ordered by a hash of the text; lines are told by 128 bits of hash; very long texts are
one row for each line until they are cut; extra columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold, forget, keyed, numbered, settle, sliced, unfold

MIN_LINES = 2
#: Words of a line whose later copies go also where it repeats alone.
LONG = 50
_BLANKS = " \t\x0b\x0c\r"
_FULL = r"[^ \t\x0B\x0C\r]"


def _ranked(pairs: DataFrame, columns: list[str], *more: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``pairs`` (_key, seq and the columns) whose columns repeat: _key, seq, rank in the columns' order; the classes: columns, n, rank."""
    repeated = pairs.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = settle(numbered(repeated, columns, "new"))
    out = settle(pairs.join(classes.drop("n"), columns).select("_key", "seq", F.col("new").alias("rank"), *more))
    return out, classes.withColumnRenamed("new", "class")


def repeated_runs(docs: DataFrame, least: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (_key, text): suffixes (_key, seq, depth, rank, len, n, head) of all open intervals from depth ``least`` on, and long lines (_key, seq, rank).

    An interval is (depth, rank): a run of len lines with n copies, the first at head (_key, seq).
    seq counts non-blank lines.
    """
    full = F.filter(F.split("text", "\n"), lambda x: x.rlike(_FULL))
    lines = docs.select("_key", F.posexplode(full).alias("seq", "line"))
    hashes = F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("b"), "line").alias("h2")
    wide = (F.regexp_count("line", F.lit(f"{_FULL}+")) >= LONG).alias("wide")
    lines = settle(lines.select("_key", "seq", *hashes, wide))
    ranks, classes = _ranked(lines, ["h1", "h2"], "wide")
    forget(lines)
    levels, found = [ranks], []
    while True:
        depth = 1 << (len(levels) - 1)
        on = levels[-1].select("_key", (F.col("seq") - depth).alias("seq"), F.col("rank").alias("next"))
        pairs = settle(levels[-1].join(on, ["_key", "seq"]).select("_key", "seq", "rank", "next"))
        more, after = _ranked(pairs, ["rank", "next"])
        forget(pairs)
        if depth >= least:  # intervals that do not go on together
            whole = after.select(F.col("rank").alias("class"), "n")
            open_ = settle(classes.select("class", "n").join(whole, ["class", "n"], "left_anti").withColumnRenamed("class", "rank"))
            found.append(levels[-1].join(open_, "rank").select("_key", "seq", F.lit(depth).alias("depth"), "rank", "n"))
        if more.isEmpty():
            break
        levels.append(more)
        classes = after
    alone = ranks.where("wide").select("_key", "seq", "rank")
    if not found:
        empty = alone.limit(0)
        return empty.select("_key", "seq", *(F.lit(0).alias(c) for c in ("depth",)), "rank", F.lit(0).alias("len"), F.lit(0).alias("n"), F.struct("_key", "seq").alias("head")), alone
    suffixes = found[0]
    for x in found[1:]:
        suffixes = suffixes.unionAll(x)
    suffixes = settle(suffixes.withColumn("len", F.col("depth")))
    for j in range(len(levels) - 2, -1, -1):  # steps of 2^j lines, for intervals deeper than that
        at = levels[j].select("_key", F.col("seq").alias("at"), F.col("rank").alias("next"))
        own = suffixes.where(F.col("depth") > 1 << j).withColumn("at", F.col("seq") + F.col("len"))
        steps = own.join(at, ["_key", "at"]).groupBy("depth", "rank", "n").agg(
            F.count(F.lit(1)).alias("c"), F.min("next").alias("low"), F.max("next").alias("high")
        )
        steps = settle(steps.where("c = n and low = high").select("depth", "rank", F.lit(1 << j).alias("step")))
        longer = settle(
            suffixes.join(steps, ["depth", "rank"], "left")
            .select("_key", "seq", "depth", "rank", "n", (F.col("len") + F.coalesce("step", F.lit(0))).alias("len"))
        )
        forget(suffixes, steps)
        suffixes = longer
    heads = settle(suffixes.groupBy("depth", "rank").agg(F.min(F.struct("_key", "seq")).alias("head")))
    return suffixes.join(heads, ["depth", "rank"]), alone


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Of ``docs`` (_key, text): _key, gone (array of the runs of lines to delete: seq, len). ``min_lines`` is a power of two."""
    if min_lines & (min_lines - 1) or min_lines < 1:
        raise ValueError(f"min_lines is a power of two, as depths are, not {min_lines}")
    suffixes, alone = repeated_runs(docs, min_lines)
    place = F.struct("_key", "seq")
    runs = suffixes.where(place != F.col("head")).select("_key", "seq", "len")
    firsts = settle(alone.groupBy("rank").agg(F.min(place).alias("head")))
    single = alone.join(firsts, "rank").where(place != F.col("head")).select("_key", "seq", F.lit(1).alias("len"))
    return runs.union(single).groupBy("_key").agg(F.collect_list(F.struct("seq", "len")).alias("gone"))


class _Delete:
    """Batches with a column ``gone`` to the text without those lines, and the numbers of lines and runs."""

    @staticmethod
    def lines(runs) -> set[int]:
        out, reach = set(), 0
        for seq, n in sorted((r["seq"], r["len"]) for r in runs):
            out.update(range(max(seq, reach), seq + n))
            reach = max(reach, seq + n)
        return out

    def __call__(self, batches):
        for batch in sliced(batches):
            names = batch.schema.names
            at, gone_at = names.index("text"), names.index("_gone")
            texts, total, gone_n, runs = [], [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(gone_at).to_pylist()):
                gone, kept, seq, run, inside = self.lines(gone or ()), [], 0, 0, False
                lines = [] if text is None else text.split("\n")
                for line in lines:
                    if not line.strip(_BLANKS):
                        kept.append(line)
                        continue
                    if seq not in gone:
                        kept.append(line)
                    run += seq in gone and not inside
                    inside = seq in gone
                    seq += 1
                texts.append(None if text is None else "\n".join(kept))
                total.append(len(lines))
                gone_n.append(len(gone))
                runs.append(run)
            columns = {n: c for n, c in zip(names, batch.columns) if n != "_gone"}
            columns["text"] = pa.array(texts, pa.string())
            columns |= {k: pa.array(v, pa.int64()) for k, v in (("_lines", total), ("_deleted", gone_n), ("_runs", runs))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _deleted(docs: DataFrame, min_lines: int) -> DataFrame:
    """``docs`` (doc_id, text, maybe _rest) without the later copies in its text, and _lines, _deleted, _runs."""
    own = keyed(docs)
    gone = deleted_lines(own.select("_key", "text"), min_lines).withColumnRenamed("gone", "_gone")
    schema = StructType([*docs.schema.fields])
    for name in ("_lines", "_deleted", "_runs"):
        schema = schema.add(name, "long")
    return own.join(gone, "_key", "left").select(*docs.columns, "_gone").mapInArrow(_Delete(), schema)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with the later copies deleted from its text (and n_chars, where it is there, counted again)."""
    return unfold(_deleted(fold(docs), min_lines), docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, n_runs, kept_sha256 (null texts: of the empty text)."""
    return _deleted(docs.select("doc_id", "text"), MIN_LINES).select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_deleted").alias("n_deleted"),
        F.col("_runs").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


#: Lines that start or go on a run of two that also starts earlier, and long lines that occur earlier.
ORACLE = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
marked AS (SELECT *, regexp_matches(line, '[^ \t\x0B\x0C\r]') AS has FROM split),
seqs AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq FROM marked WHERE has),
pairs AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt FROM seqs),
later AS (
  SELECT doc_id, seq FROM (
    SELECT doc_id, seq, row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, seq) AS nth
    FROM pairs WHERE nxt IS NOT NULL) WHERE nth > 1),
single AS (
  SELECT doc_id, seq FROM (SELECT doc_id, seq, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) AS nth FROM seqs)
  WHERE nth > 1 AND len(regexp_extract_all(line, '[^ \t\x0B\x0C\r]+')) >= 50),
gone AS (SELECT doc_id, seq FROM later UNION SELECT doc_id, seq + 1 FROM later UNION SELECT doc_id, seq FROM single),
runs AS (
  SELECT doc_id, count(*) AS n_deleted, count(*) FILTER (WHERE before IS NULL OR before <> seq - 1) AS n_runs
  FROM (SELECT doc_id, seq, lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM gone) GROUP BY doc_id),
kept AS (
  SELECT m.doc_id, string_agg(m.line, chr(10) ORDER BY m.i) AS text
  FROM marked m LEFT JOIN seqs s ON m.doc_id = s.doc_id AND m.i = s.i
  LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.seq = g.seq WHERE g.seq IS NULL GROUP BY m.doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(r.n_deleted, 0)::BIGINT AS n_deleted, coalesce(r.n_runs, 0)::BIGINT AS n_runs,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN runs r ON d.doc_id = r.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def brute_force(rows: list[tuple[int, str]], min_lines: int = MIN_LINES) -> list[tuple]:
    """op4 for a small fixture, straight from the definition."""
    seen, out = set(), []
    long = lambda x: len([w for w in re.split(f"[{_BLANKS}]+", x) if w]) >= LONG
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        lines = [] if text is None else text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(_BLANKS)]
        gone = set()
        for s in range(len(at) - min_lines + 1):
            run = tuple(lines[i] for i in at[s : s + min_lines])
            if run in seen:
                gone |= set(range(s, s + min_lines))
            seen.add(run)
        for s in range(len(at)):
            if lines[at[s]] in seen and long(lines[at[s]]):
                gone.add(s)
            seen.add(lines[at[s]])
        runs = sum(1 for s in gone if s - 1 not in gone)
        drop = {at[s] for s in gone}
        kept = "\n".join(x for i, x in enumerate(lines) if i not in drop)
        out.append((doc_id, len(lines), len(gone), runs, hashlib.sha256(kept.encode()).hexdigest()))
    return out
