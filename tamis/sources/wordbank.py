"""Word bank (S1) and rule pack (S2) sources.

Word bank CSV: no header, ``#`` at column 0 starts a comment, exactly four fields
``word,type,severity,action``, every field trimmed of Unicode white space, rows with
a blank word skipped, a repeated word keeps its *last* row. Rows with the wrong
number of fields are dropped and counted (``mode="drop"``) or fail the load
(``mode="fail"``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis import fixed, schemas
from tamis.session import materialize

# Unicode White_Space at either end (Java \s plus separators plus NEL).
_TRIM = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"


class WordBankError(Exception):
    """Raised as error E002 when a bank cannot be loaded."""

    code = fixed.ERR_WORD_BANK_LOAD


def _trim(c):
    return F.regexp_replace(c, _TRIM, "")


def load_word_bank(spark: SparkSession, path: str, mode: str = "drop", with_bad_count: bool = False):
    """Load a word bank CSV as DataFrame(word, type, severity, action), unique on word."""
    if mode not in ("drop", "fail"):
        raise ValueError("mode must be 'drop' or 'fail'")
    schema = "word STRING, type STRING, severity STRING, action STRING, _bad STRING"
    try:
        raw = (spark.read.schema(schema)
               .option("comment", "#").option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", "_bad")
               .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
               .option("multiLine", "true").option("quote", '"').option("escape", '"')
               .csv(path))
        # line order: file, then the split's start offset, then the row's place inside
        # its split (monotonically_increasing_id right after the read, before any
        # shuffle) - exact even when a big bank file is cut into several splits
        raw = raw.withColumn("_line", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                               F.monotonically_increasing_id()))
        raw = materialize(spark, raw, "bank")  # read twice; a column of bad rows alone cannot be queried from a CSV scan
        n_bad = raw.filter(F.col("_bad").isNotNull()).count()
    except Exception as e:  # missing file and the like
        raise WordBankError(f"[{fixed.ERR_WORD_BANK_LOAD}] failed to open word bank file: {e}") from e
    if n_bad and mode == "fail":
        raise WordBankError(f"[{fixed.ERR_WORD_BANK_LOAD}] {n_bad} malformed row(s) in {path}")
    good = (raw.filter(F.col("_bad").isNull())
            .select(*[_trim(F.col(c)).alias(c) for c in ("word", "type", "severity", "action")], "_line")
            .filter(F.col("word").isNotNull() & (F.col("word") != "")))
    bank = (good.groupBy("word")
            .agg(F.max_by(F.struct("type", "severity", "action"), F.col("_line")).alias("r"))
            .select("word",
                    F.coalesce("r.type", F.lit("")).alias("type"),
                    F.coalesce("r.severity", F.lit("")).alias("severity"),
                    F.coalesce("r.action", F.lit("")).alias("action")))
    return (bank, n_bad) if with_bad_count else bank


def bank_from_rows(spark: SparkSession, rows) -> DataFrame:
    """A bank from (word, type, severity, action) tuples; last row of a word wins."""
    last = {}
    for r in rows:
        w = r[0].strip() if r[0] is not None else ""
        if w:
            last[w] = tuple(r)
    return spark.createDataFrame(list(last.values()), schemas.BANK)


def by_type(bank: DataFrame) -> DataFrame:
    """type -> number of words and their sorted list; blank types left out (B4)."""
    return (bank.filter(F.col("type").isNotNull() & (F.col("type") != ""))
            .groupBy("type")
            .agg(F.count(F.lit(1)).alias("n_words"), F.array_sort(F.collect_list("word")).alias("words")))


def rules_from_rows(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schemas.RULES)


def default_rules(spark: SparkSession) -> DataFrame:
    return rules_from_rows(spark, fixed.DEFAULT_RULES)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule pack: YAML with a ``patterns`` list (config-size, parsed on the driver), or a
    JSON / parquet / CSV table with columns name, pattern, type, severity, action."""
    ext = os.path.splitext(path)[1].lower()
    if ext in (".yaml", ".yml"):
        import yaml
        doc = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}
        rows = []
        for r in doc.get("patterns", []) or []:
            rows.append((str(r.get("name", "")), str(r.get("pattern", "")), r.get("type"),
                         r.get("severity"), r.get("action")))
        return rules_from_rows(spark, rows)
    reader = spark.read.schema(schemas.RULES)
    if ext == ".json":
        return reader.json(path)
    if ext == ".csv":
        return reader.option("header", "true").csv(path)
    return spark.read.parquet(path).select(*schemas.RULES.fieldNames())
