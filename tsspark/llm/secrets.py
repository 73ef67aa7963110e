"""Secret scan with an incremental ledger of blobs.

Every version of every file is addressed by the SHA-256 of its content. The ledger holds one row per scan of
a blob: the rule versions that were run, and what they found. A scan runs only the pairs of blob and rule
version that the ledger lacks, appends them, and joins the findings back to every path that has the blob.
A copy, a rename or a revert therefore costs a hash, and a new rule version runs alone.

Spans are code points, end exclusive. Null content counts as empty. A finding's position is the whole match.
That of a private key reaches from its header through its END line, whatever stands between; where END is missing, through the
header fields and lines of base64 that follow.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsspark.llm.common import in_batches, texts_of

FOUND = "array<struct<rule:string,version:int,start:int,end:int>>"
LEDGER = f"blob_id string, rules array<string>, findings {FOUND}"


class Rule(NamedTuple):
    """``pattern`` finds candidates, leftmost and non-overlapping; those with a shorter ``group`` are dropped."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"


#: The three base rules and public formats of credentials.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)
_KEY = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
# a line break and what opens the next line, also within a quoted literal, a comment or a reply
_LINE = r"""[\x20\t"'+,>#*|]*+(?:\r?\n|\\r\\n|\\n)(?:[\s"'+,>#*|]|\\[nr])*+"""
_LAST = r"""[A-Za-z0-9+/=]++(?=[\x20\t"'+,;]*(?:[\r\n\\]|\Z))"""
_FIELDS = rf"(?:{_LINE}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+)*+"
_BASE64 = rf"(?:(?:{_LINE}|\x20++)[A-Za-z0-9+/=]{{16,}}+(?:\x20++{_LAST})?|{_LINE}{_LAST})*+"
# to the END line; where the next such line is none, the header fields and the lines of base64 that follow
_BODY = rf"(?:[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END {_KEY}|{_FIELDS}{_BASE64})"
EXTRA = (
    Rule("private_key", 2, rf"-----BEGIN {_KEY}{_BODY}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", 2, r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@\"'<>]++:[^\x00-\x20/@\"'<>]++@[A-Za-z0-9.-]+"),
)
RULES = BASE + EXTRA


def _spans(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


#: A cheap linear test that every text with a finding of the rule passes.
_HINTS = {"private_key": rf"-----BEGIN {_KEY}", "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "url_login": "://[^/ ]+@"}


def _scan(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob_id``, ``todo`` (rule ids) and ``content`` to ledger rows."""
    known = {r.id: r for r in rules}
    order = {r.id: k for k, r in enumerate(rules)}
    struct = pa.struct([("rule", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, todo = texts_of(batch, "content"), batch.column("todo").to_pylist()
        found: list[list[tuple]] = [[] for _ in todo]
        for rule in known.values():
            compiled = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))
            hint = _HINTS.get(rule.name, rule.pattern) if rule in RULES else None
            likely = pc.indices_nonzero(pc.match_substring_regex(texts, hint)).to_pylist() if hint else range(len(todo))
            for i in likely:
                if rule.id in todo[i]:
                    found[i] += [(a, order[rule.id], b) for a, b in _spans(rule, compiled, texts[i].as_py())]
        ids = list(known)
        rows = [[{"rule": known[ids[k]].name, "version": known[ids[k]].version, "start": a, "end": b} for a, k, b in sorted(x)] for x in found]
        return pa.RecordBatch.from_arrays([batch.column("blob_id"), batch.column("todo"), pa.array(rows, pa.list_(struct))], ["blob_id", "rules", "findings"])

    return in_batches(df.select("blob_id", "todo", "content"), work, LEDGER)


def blob_id(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far; an empty one where none was written yet."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, content: str = "text") -> None:
    """Scan what the ledger lacks of ``versions`` and append it.

    One content per blob is taken before the scan; the map side of that grouping leaves one row per blob and
    task, so a blob with very many paths is no hot key. If the job is lost midway nothing is committed, and a
    repeated scan only adds equal rows, which the readers fold together.
    """
    spark = versions.sparkSession
    current = F.array(*[F.lit(r.id) for r in rules])
    blobs = versions.select(blob_id(F.col(content)).alias("blob_id"), F.coalesce(F.col(content), F.lit("")).alias("content")).groupBy("blob_id").agg(F.first("content").alias("content"))
    seen = read_ledger(spark, ledger).select("blob_id", F.explode("rules").alias("rule")).groupBy("blob_id").agg(F.collect_set("rule").alias("seen"))
    lacking = F.array_except(current, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
    todo = blobs.join(seen, "blob_id", "left").select("blob_id", "content", lacking.alias("todo")).where(F.size("todo") > 0)
    _scan(todo, rules).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings of the given rule versions, ordered by start, then by rule as listed."""
    wanted = [r.id for r in rules]
    rank = F.array_position(F.array(*[F.lit(x) for x in wanted]), F.concat(F.col("f.rule"), F.lit("@"), F.col("f.version")))
    rows = read_ledger(spark, ledger).select("blob_id", F.explode("findings").alias("f")).withColumn("rank", rank).where(F.col("rank") > 0)
    found = rows.groupBy("blob_id").agg(F.sort_array(F.collect_set(F.struct(F.col("f.start").alias("start"), "rank", F.col("f.end").alias("end"), F.col("f.rule").alias("rule")))).alias("findings"))
    return found


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, content: str = "text") -> DataFrame:
    """The versions with their other columns, without content, plus ``blob_id`` and ``findings`` (never null)."""
    update_ledger(versions, ledger, rules, content)
    found = findings(versions.sparkSession, ledger, rules)
    named = versions.withColumn("blob_id", blob_id(F.col(content))).drop(content)
    return _with_findings(named, found)


def _with_findings(named: DataFrame, found: DataFrame) -> DataFrame:
    none = F.array().cast(found.schema["findings"].dataType)
    joined = named.join(found.withColumnRenamed("findings", "found_here"), "blob_id", "left")
    return joined.withColumn("findings", F.coalesce("found_here", none)).drop("found_here")


def redact(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, content: str = "text", mark: str = "[secret]") -> DataFrame:
    """The versions, all columns, with every found span replaced by ``mark``; overlapping spans become one."""
    update_ledger(versions, ledger, rules, content)
    found = findings(versions.sparkSession, ledger, rules).withColumnRenamed("findings", "__found").withColumnRenamed("blob_id", "__blob")
    rows = versions.withColumn("__blob", blob_id(F.col(content))).join(found, "__blob", "left")
    text = F.col(content)

    def step(state: Column, f: Column) -> Column:
        past = f["start"] >= state["at"]
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, f["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], f["end"]).alias("at"), F.when(past, more).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("__found", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return rows.withColumn(content, F.when(F.col("__found").isNull(), text).otherwise(clean)).select(*versions.columns)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base rules, the base spans' digest and all spans as text."""
    written = lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])
    base = F.filter("findings", lambda x: x["rule"].isin([r.name for r in BASE]))
    count = lambda name: F.size(F.filter("findings", lambda x: x["rule"] == name)).cast("long")
    return scanned.select(
        key,
        *[count(r.name).alias(f"n_{r.name}") for r in BASE],
        F.sha2(F.array_join(F.transform(base, written), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", written), ",").alias("spans"),
    )
