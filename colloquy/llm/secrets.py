"""Secrets in every version of every file, by an incremental ledger of blobs.

Each version's text is a blob, addressed by its SHA-256 and stored once. A scan reads only blobs with a
rule, in its version, that they have not been scanned by; findings belong to blobs and are joined
back to all paths and versions that hold them. Everything runs in DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import cluster


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches of pattern that do not overlap, of which those with `least` characters or more in `group` count.

    Raise the version with any change: blobs are then scanned again by this rule alone. holds: a text without it cannot match.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    holds: str | None = None

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


def _either(word: str) -> str:
    """A pattern for word with ASCII letters in either case; no other letters fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base kinds, in their order. Runs of one class are maximal, so a least length in the pattern finds the same as one after it.
ASSIGN = rf"({'|'.join(_either(w) for w in ('password', 'passwd', 'secret', 'token', 'api_?key'))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (
    Rule("assign", ASSIGN, group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}", holds="AKIA"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Further kinds: private keys, web tokens, prefixed service tokens, credentials in addresses.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", holds="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", holds="eyJ"),
    Rule("service", r"(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
    Rule("url", r"[a-z]{2,12}://[A-Za-z0-9._%-]{1,64}:[^\s/@:]{6,128}@", holds="://"),
)
RULES = (*BASE, *MORE)


def _matches(rule: Rule, text: Column, wanted: Column) -> Column:
    """Array of the rule's matches in order, whole or, for a rule with a group, with the group's length: empty where the rule is not wanted."""
    asked = wanted & F.contains(text, F.lit(rule.holds)) if rule.holds else wanted
    return F.when(asked, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _pieces(place: int, rule: Rule, text: Column, matches: Column) -> Column:
    """Of each match: the rule's place, the match's number, the characters before it since the last one, its own, and whether it is long enough."""
    length = F.transform(matches, F.char_length)
    checked = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length) if rule.group else length
    gap = F.slice(F.transform(F.split(text, rule.pattern, -1), F.char_length), 1, F.size(matches))

    def piece(x: Column, n: Column) -> Column:
        return F.struct(F.lit(place).alias("rule"), n.alias("n"), x["gap"].alias("gap"), x["length"].alias("length"), (x["checked"] >= rule.least).alias("ok"))

    return F.transform(F.arrays_zip(gap.alias("gap"), length.alias("length"), checked.alias("checked")), piece)


def spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, scanned (tags of rules), found (array of at, kind, end by start and then by the order of rules) for blobs (blob, text, todo: tags).

    Offsets are in code points, end exclusive. A text that is cut at a rule's matches has pieces between them: the lengths of pieces and
    matches, summed up in order, give the offsets, in a window over the matches of one text, so the work is linear in them.
    """
    cut = blobs.select("blob", "todo", "text", *(_matches(r, F.col("text"), F.array_contains("todo", r.tag)).alias(f"m{i}") for i, r in enumerate(rules)))
    none = F.array().cast("array<struct<rule: int, n: int, gap: int, length: int, ok: boolean>>")
    every = F.concat(*(F.when(F.size(f"m{i}") > 0, _pieces(i, r, F.col("text"), F.col(f"m{i}"))).otherwise(none) for i, r in enumerate(rules)))
    flat = cut.select("blob", F.col("todo").alias("scanned"), every.alias("every")).repartition("blob").select("blob", "scanned", F.explode_outer("every").alias("m"))
    upto = F.sum(F.col("m.gap").cast("long") + F.col("m.length")).over(cluster.running("blob", "m.rule", by="m.n"))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    at = flat.select("blob", "scanned", F.col("m.ok").alias("ok"), F.col("m.rule").alias("rule"), F.col("m.length").alias("length"), upto.alias("end"))
    span = F.struct((F.col("end") - F.col("length")).alias("start"), F.col("rule").alias("rule"), F.col("end").alias("end"), F.get(kinds, F.col("rule")).alias("kind"))
    grouped = at.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.sort_array(F.collect_list(F.when(F.col("ok"), span))).alias("spans"))
    return grouped.select("blob", "scanned", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("found"))


class Ledger:
    """Blobs, paths and findings below a folder that all executors share; each is a Parquet table that is only appended to.

    A commit first stores new blobs, then its paths; a scan appends what it has scanned together with what it has found. A job
    that was cut short between two writes is simply run again: blobs that are stored or scanned are not taken twice.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
        return self.spark.read.schema(schema).parquet(path) if there else None

    def blobs(self) -> DataFrame | None:
        return self._table("blobs", "blob binary, text string")

    def paths(self, schema: str) -> DataFrame | None:
        return self._table("paths", schema)

    def scans(self) -> DataFrame | None:
        return self._table("scans", "blob binary, scanned array<string>, found array<struct<start: bigint, end: bigint, kind: string>>")

    def commit(self, versions: DataFrame, text: str = "text") -> None:
        """Take up versions: one row each, whatever its columns name (path, commit, time); a null text is an empty one. Each content is stored once."""
        blob = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        rest = [c for c in versions.columns if c != text]
        taken = cluster.fresh(versions, "blob")
        new = versions.select(blob.alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
        old = self.blobs()
        if old is not None:
            new = new.join(old.select("blob"), "blob", "left_anti")
        new.write.mode("append").parquet(f"{self.folder}/blobs")
        versions.select(*(F.col(f"`{c}`") for c in rest), blob.alias(taken)).write.mode("append").parquet(f"{self.folder}/paths")

    def todo(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, text, todo: blobs that some of the rules, in their version, has not seen, with the tags of those."""
        wanted, blobs, done = F.array(*(F.lit(r.tag) for r in rules)), self.blobs(), self.scans()
        if done is None:
            return blobs.withColumn("todo", wanted)
        seen = done.select("blob", F.explode("scanned").alias("tag")).groupBy("blob").agg(F.collect_set("tag").alias("seen"))
        left = blobs.select("blob").join(seen, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        return blobs.join(left.filter(F.size("todo") > 0), "blob")

    def scan(self, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the pairs of blob and rule version that were not scanned yet."""
        spans(self.todo(rules), rules).write.mode("append").parquet(f"{self.folder}/scans")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, found: of each blob with one, the spans (start, end, kind) that the given rule versions have found, by start and order of rules."""
        kinds = F.array(*(F.lit(r.kind) for r in rules))
        tags = F.array(*(F.lit(r.tag) for r in rules))
        known = F.filter("found", lambda s: F.array_contains(F.col("scanned"), F.get(tags, (F.array_position(kinds, s["kind"]) - 1).cast("int"))))
        rows = self.scans().select("blob", F.explode(known).alias("s")).select("blob", F.struct(F.col("s.start").alias("start"), F.array_position(kinds, F.col("s.kind")).alias("place"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind")).alias("s"))
        return rows.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("found"))


def of_kinds(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def joined(found: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of documents, through the ledger: commit, scan, and findings joined back to every row of the ledger.

    Returns doc_id, n_assign, n_access, n_hex (spans of the base kinds), base_sha256 (of these spans, kind:start:end by start, joined by commas),
    spans (those of all kinds likewise) and n_spans. Offsets are code points, end exclusive.

    A null text is an empty one and has no spans. Repeated rows, rows of one doc_id with different texts (versions) and rows with a null
    doc_id are returned each; an empty table gives no rows; other columns are not read. A text of any length is searched whole: spans
    of one text are gathered in one row, never those of several. Copies, however many, are scanned once.
    """
    ledger.commit(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    ledger.scan(rules)
    kind = documents.schema[key].dataType.simpleString()
    rows = ledger.paths(f"doc_id {kind}, blob binary").join(ledger.findings(rules), "blob", "left")
    found = F.coalesce("found", F.array().cast("array<struct<start: bigint, place: bigint, end: bigint, kind: string>>"))
    counts = (F.size(of_kinds(found, r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE)
    base = joined(of_kinds(found, *(r.kind for r in BASE)))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(found).alias("spans"), F.size(found).cast("long").alias("n_spans"))


def _sql() -> str:
    def one(place: int, r: Rule) -> str:
        pattern = r.pattern.replace("'", "''")
        return f"""
  select doc_id, {place} as place, '{r.kind}' as kind, unnest(list_transform(string_split_regex(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}'))], lambda x: length(x))) as gap,
    unnest(list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x))) as len, unnest(list_transform(regexp_extract_all(t, '{pattern}', {r.group}), lambda x: length(x))) >= {r.least} as ok,
    unnest(range(len(regexp_extract_all(t, '{pattern}')))) as n
  from d"""

    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(one(i, r) for i, r in enumerate(RULES))}),
e as (select *, sum(gap + len) over (partition by doc_id, place order by n) as stop from m),
s as (select doc_id, place, kind, (stop - len)::bigint as start, kind || ':' || (stop - len)::bigint || ':' || stop::bigint as span from e where ok),
g as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(span, ',' order by start, place) filter (place < {len(BASE)}) as base, string_agg(span, ',' order by start, place) as spans, count(*) as n_spans
  from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_spans, 0) as n_spans
from d left join g using (doc_id)"""


SQL = _sql()
