"""Secret scanning over an incremental ledger of blobs (DataFrame functions only).

Every version of every text is addressed by the SHA-256 of its UTF-8 bytes (its
*blob*).  The ledger is a folder of two tables:

* ``scanned``  -- ``blob, rule``: this blob was searched with this version of this rule;
* ``findings`` -- ``blob, rule, kind, start, end``: what was found (code points, end exclusive).

A scan searches only pairs of blob and rule version that the ledger lacks, writes what it
finds, then marks the pairs as scanned, and joins findings back to every path that holds the
blob.  Findings are written first: a run that dies in between repeats pairs, and
reading drops the repeats.

Positions come from built-in functions: ``split`` gives the text between matches
and ``regexp_extract_all`` the matches, and a running sum over the lengths of both is the
place of each match in code points.

Edge cases: a null text is empty and has no findings; rows that repeat share a blob and
each gets its row; a null id stays null; extra columns are not carried; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import lookup, new_folder, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A search: ``value_group`` of a match must have at least ``least`` characters."""

    kind: str
    pattern: str
    value_group: int
    least: int
    revision: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}@{self.revision}"


#: The three base searches.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # a run is taken to its end, so the least length can stand in the pattern
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

_SCANNED = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType()))])
_FINDINGS = T.StructType([
    T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _exists(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _ledger_table(spark, ledger: str, name: str, schema: T.StructType) -> DataFrame:
    """A table of the ledger; empty when the ledger is new."""
    if not _exists(spark, f"{ledger}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{ledger}/{name}")


def _found(unseen: DataFrame, rule: Rule) -> DataFrame:
    """Rows of ``findings`` for one rule over the blobs that lack it."""
    hit = unseen.where(F.array_contains("rules", rule.version) & F.col("text").rlike(rule.pattern))
    matches = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.value_group))
    pieces = hit.select(
        "blob",
        F.posexplode(F.arrays_zip(
            F.transform(F.split("text", rule.pattern, -1), F.char_length).alias("between"),
            F.transform(matches, F.char_length).alias("taken"),
            F.transform(values, F.char_length).alias("worth"))).alias("i", "p"))
    # one blob's matches in order: a window over what a single text holds
    before = Window.partitionBy("blob").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("p.between") + F.coalesce("p.taken", F.lit(0))).over(before)
    return (pieces.select("blob", "p", end.cast("long").alias("end"))
            .where(F.col("p.worth") >= rule.least)
            .select("blob", F.lit(rule.version).alias("rule"), F.lit(rule.kind).alias("kind"),
                    (F.col("end") - F.col("p.taken")).alias("start"), "end"))


def update_ledger(versions: DataFrame, ledger: str, rules=BASE_RULES, text_col: str = "text") -> None:
    """Search what the ledger at ``ledger`` has not seen of ``versions`` and add it to the ledger."""
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.version) for r in rules])
    blobs = versions.select(F.sha2(text_or_empty(text_col), 256).alias("blob"), text_or_empty(text_col).alias("text"))
    seen = (_ledger_table(spark, ledger, "scanned", _SCANNED)
            .groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done")))
    lacking = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    # the ledger, if there is one, is consulted before the texts move; equal texts meet after map-side combining
    told = lookup(blobs, seen, "blob") if _exists(spark, f"{ledger}/scanned") else blobs.withColumn("done", F.lit(None).cast("array<string>"))
    unseen = (told.select("blob", "text", lacking.alias("rules")).where(F.size("rules") > 0)
              .groupBy("blob").agg(F.first("text").alias("text"), F.first("rules").alias("rules")))
    found = None
    for rule in rules:
        part = _found(unseen, rule)
        found = part if found is None else found.unionByName(part)
    found.write.mode("append").parquet(f"{ledger}/findings")
    marks = (blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", lacking.alias("rules"))
             .where(F.size("rules") > 0))
    marks.write.mode("append").parquet(f"{ledger}/scanned")


def _per_blob(spark, ledger: str, rules) -> DataFrame:
    """``blob, spans`` from the ledger's findings by ``rules``."""
    place = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    return (_ledger_table(spark, ledger, "findings", _FINDINGS)
            .where(F.col("rule").isin([r.version for r in rules]))
            .distinct()
            .groupBy("blob")
            .agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("spans")))


def findings_by_path(versions: DataFrame, ledger: str, rules=BASE_RULES, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``id_col, blob, spans`` for every row of ``versions``: its findings by start, then by the order of the rules.

    ``spans`` is an array of ``(start, place, end, kind)``, empty where nothing was found.
    """
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    paths = versions.select(F.col(id_col).alias("__id"), F.sha2(text_or_empty(text_col), 256).alias("blob"))
    found = lookup(paths, _per_blob(versions.sparkSession, ledger, rules), "blob")
    return found.select(F.col("__id").alias(id_col), "blob", F.coalesce("spans", none).alias("spans"))


def scan(versions: DataFrame, ledger: str | None = None, rules=BASE_RULES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date with ``versions`` and return every path's findings.

    Without ``ledger`` a new one is laid below the session's checkpoint folder.
    """
    ledger = ledger or new_folder(versions.sparkSession, "ledger")
    update_ledger(versions, ledger, rules, text_col)
    return findings_by_path(versions, ledger, rules, id_col, text_col)


def joined_spans(spans) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text, spans, mark: str = "[secret]") -> F.Column:
    """``text`` with each run of covered code points replaced by ``mark`` (null stays null)."""
    state = F.struct(F.lit("").alias("made"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(F.concat(a["made"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                          F.lit(mark)).alias("made"), s["end"].alias("at"))
    ).otherwise(F.struct(a["made"].alias("made"), F.greatest(a["at"], s["end"]).alias("at")))
    return F.aggregate(spans, state, step, lambda a: F.concat(
        a["made"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))))


def redact(versions: DataFrame, ledger: str | None = None, rules=BASE_RULES, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``versions`` with all columns, its findings replaced by ``mark`` in the text; the ledger is brought up to date."""
    ledger = ledger or new_folder(versions.sparkSession, "ledger")
    update_ledger(versions, ledger, rules, text_col)
    found = _per_blob(versions.sparkSession, ledger, rules).withColumnsRenamed({"blob": "__blob", "spans": "__spans"})
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), F.col("__spans"), mark))
    named = versions.withColumn("__blob", F.sha2(text_or_empty(text_col), 256))
    return lookup(named, found, "__blob").withColumn(text_col, text).select(versions.columns)
