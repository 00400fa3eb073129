"""Secret scan over an incremental ledger of blobs.

Every version of a text is named by its content. The ledger holds, for each blob, the
rules (with their version) that have been applied to it and what they found. A scan applies
to each blob only the rules that the ledger lacks, once however many paths hold it, and joins
the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import pattern_matches
from tidewatch.session import written


@dataclass(frozen=True)
class Rule:
    """A pattern, the signs that a text must contain for it (none: any text), and a test of a match."""

    name: str
    version: int
    pattern: str
    needs: tuple[str, ...] = ()
    least_value: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# Base rules first, in their order; then formats of well-known credentials (fixed values).
_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", 1, _ASSIGN + r"[A-Za-z0-9+/_.=-]+", least_value=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyJ",)),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("gh",)),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("url_login", 1, r"://[^\s:/@]{1,256}:[^\s:/@]{1,256}@", ("://",)),
)
BASE = ("assign", "access", "hex")

LEDGER = (
    ("blob", "string"),
    ("scanned", "array<string>"),
    ("findings", "array<struct<rule:string,start:bigint,end:bigint>>"),
)


def spans_of(text: Column, rule: Rule) -> Column:
    """``array<struct<rule, start, end>>`` of a rule in a text."""
    found = pattern_matches(text, rule.pattern)
    if rule.least_value:
        # What is left of a match without its name and sign is the value.
        found = F.filter(
            found,
            lambda m: F.length(F.regexp_replace(m["match"], "^" + _ASSIGN, "")) >= rule.least_value,
        )
    spans = F.transform(
        found, lambda m: F.struct(F.lit(rule.name).alias("rule"), m["start"], m["end"])
    )
    none = F.array().cast("array<struct<rule:string,start:bigint,end:bigint>>")
    for sign in rule.needs:
        spans = F.when(text.contains(sign), spans).otherwise(none)
    return spans


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple = RULES
) -> DataFrame:
    """The ledger rows of all blobs in ``versions``: those it lacked, in whole or in part, scanned.

    A blob with all of ``rules`` in the ledger is not scanned; another is scanned with the rules that
    are missing. Findings of older versions of a rule stay with the blob's row until it is
    scanned with a newer one. A null text is the empty blob.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(blob_of(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        fields = (F.lit(None).cast(kind).alias(name) for name, kind in LEDGER)
        ledger = versions.sparkSession.range(0).select(*fields)
    # Other names than the result's: inside a lambda Spark would take those for the new columns.
    known = ledger.select("blob", F.col("scanned").alias("had"), F.col("findings").alias("found"))
    rows = blobs.join(known, "blob", "left")
    wanted = F.array(*[F.lit(r.key) for r in rules])
    done = F.coalesce("had", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<rule:string,start:bigint,end:bigint>>")
    new = [
        F.when(F.array_contains(done, r.key), none).otherwise(spans_of(F.col("text"), r)) for r in rules
    ]
    renewed = F.array(*[F.when(~F.array_contains(done, r.key), F.lit(r.name)) for r in rules])
    kept = F.filter(
        F.coalesce("found", none), lambda f: ~F.coalesce(F.array_contains(renewed, f["rule"]), F.lit(False))
    )
    return rows.select(
        "blob",
        F.array_union(done, wanted).alias("scanned"),
        F.concat(kept, *new).alias("findings"),
    )


def findings(
    versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id",
    text_col: str = "text", rules: tuple = RULES,
) -> tuple[DataFrame, DataFrame]:
    """``id, blob, findings`` for each row of ``versions``, and the rows to put in the ledger.

    Findings are ordered by start, then by the rules' order. Null ids and repeated rows keep their
    rows; other columns are not read. The ledger rows are written to the shared folder.
    """
    rows = written(scan(versions, ledger, text_col, rules))
    order = F.array(*[F.lit(r.name) for r in rules])
    sorted_findings = F.transform(
        F.array_sort(
            F.transform(
                "findings",
                lambda f: F.struct(
                    f["start"].alias("start"), F.array_position(order, f["rule"]).alias("place"),
                    f["end"].alias("end"), f["rule"].alias("rule"),
                ),
            )
        ),
        lambda f: F.struct(f["rule"], f["start"], f["end"]),
    )
    paths = versions.select(F.col(id_col), blob_of(F.col(text_col)).alias("blob"))
    found = rows.select("blob", sorted_findings.alias("findings"))
    return paths.join(found, "blob").select(id_col, "blob", "findings"), rows


def listed(spans: Column) -> Column:
    """``rule:start:end`` of all findings, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda f: F.concat_ws(":", f["rule"], f["start"].cast("string"), f["end"].cast("string")),
        ),
        ",",
    )
