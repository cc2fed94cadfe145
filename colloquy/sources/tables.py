"""Readers of tables and files, with alias resolution and run discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("question_id", "question_type", "session_id")]
    + [T.StructField("turn_index", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("role", "content", "dialogue_datetime", "question", "answer", "question_date")]
    + [T.StructField("has_answer", T.BooleanType()), T.StructField("is_answer_session", T.BooleanType()), T.StructField("answer_session_ids", T.StringType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """Elements of a top-level JSON array, a row each; strict: malformed text fails."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, tolerant: bool = True) -> DataFrame:
    """A row per line; blank lines are skipped, undecodable ones too if tolerant."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def csv_turns(spark: SparkSession, path: str, recursive: bool = False, schema: T.StructType = TURN_ROW) -> DataFrame:
    """Turns of CSV files with a byte-order mark allowed, blank contents dropped, and pos: the place within session and file."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).option("recursiveFileLookup", recursive).option("mode", "PERMISSIVE").csv(path)
    kept = rows.filter(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("file", F.col("_metadata.file_path")).withColumn("_order", F.monotonically_increasing_id())
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("file", "session_id").orderBy("_order")) - 1).drop("_order")


def first_rows(rows: DataFrame, file: str = "file", order: str = "pos") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(order))).filter("_n = 1").drop("_n")


def flatten_questions(questions: DataFrame) -> DataFrame:
    """question to its sessions and turns (1-based), from three parallel arrays of one length; another length or a missing id fails."""
    same = (F.size("haystack_session_ids") == F.size("haystack_dates")) & (F.size("haystack_dates") == F.size("haystack_sessions"))
    checked = questions.withColumn("_ok", F.assert_true(same & F.col("question_id").isNotNull(), F.lit("the arrays of a question differ in length, or it has no id"))).filter(F.col("_ok").isNull())
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("session_id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    sessions = checked.select("question_id", F.explode(zipped).alias("s"))
    return sessions.select("question_id", F.col("s.session_id").alias("session_id"), F.col("s.date").alias("dialogue_datetime"), F.posexplode("s.turns").alias("p", "t")).select(
        "question_id", "session_id", "dialogue_datetime", (F.col("p") + 1).alias("turn_index"), F.col("t.role").alias("role"), F.col("t.content").alias("content")
    )


def flatten_samples(samples: DataFrame) -> DataFrame:
    """sample, session number, pos, line of nested dialogues whose sessions are dynamic keys session_<n>.

    samples: sample, conversation (map of JSON strings). Turns without speaker, text and caption are dropped and take no position; sessions are ordered by number.
    """
    turn = "array<struct<speaker:string,text:string,blip_caption:string,dia_id:string>>"
    entries = samples.select("sample", F.explode("conversation").alias("key", "body")).filter(F.col("key").rlike("^session_\\d+$"))
    turns = entries.select("sample", F.regexp_extract("key", "(\\d+)", 1).cast("int").alias("session"), F.posexplode(F.from_json("body", turn)).alias("p", "t"))
    text = F.concat(F.col("t.text"), F.when(F.coalesce(F.col("t.blip_caption"), F.lit("")) != "", F.concat(F.lit(" (Image: "), F.col("t.blip_caption"), F.lit(")"))).otherwise(""))
    some = F.concat(*(F.trim(F.coalesce(F.col(f"t.{c}"), F.lit(""))) for c in ("speaker", "text", "blip_caption"))) != ""
    kept = turns.filter(some).withColumn("line", F.regexp_replace(F.concat(F.coalesce(F.col("t.speaker"), F.lit("")), F.lit(": "), F.coalesce(text, F.lit(""))), "\n", " "))
    w = Window.partitionBy("sample", "session").orderBy("p")
    return kept.select("sample", "session", (F.row_number().over(w) - 1).alias("pos"), F.col("t.dia_id").alias("dia_id"), "line")


def raw_turn_index(turns: DataFrame, index: str = "turn_index") -> DataFrame:
    """Turns by session and number; rows whose number is no whole number are skipped, of equal numbers the first by pos counts."""
    numbered = turns.withColumn(index, F.col(index).cast("string").try_cast("int")).filter(F.col(index).isNotNull())
    return numbered.withColumn("_n", F.row_number().over(Window.partitionBy("session_id", index).orderBy("pos"))).filter("_n = 1").drop("_n")


def scalars(rows: DataFrame, json: str, required: dict[str, str]) -> DataFrame:
    """Fields of a JSON object as text: numbers are written out, a missing, blank, boolean or nested one fails with its name. required: column -> field."""
    v = F.try_parse_json(F.col(json))
    out = rows
    for name, field in required.items():
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
        text = F.try_variant_get(v, f"$.{field}", "string")
        ok = text.isNotNull() & (F.trim(text) != "") & ~kind.rlike("^(BOOLEAN|ARRAY|OBJECT|VOID)")
        out = out.withColumn(name, F.when(ok, text).otherwise(F.raise_error(F.concat(F.lit(f"{field} is missing or no plain value in "), F.coalesce(F.col(json), F.lit("null"))))))
    return out


def without_adversarial(questions: DataFrame) -> DataFrame:
    """Normal questions but those of the adversarial category."""
    return questions.filter(F.col("category") != CATEGORIES[5])


def benchmark_of(columns: list[str]) -> str:
    """Which benchmark a run's file belongs to, by its columns; an error where they tell nothing or both."""
    low = {c.lstrip("\ufeff").lower() for c in columns}
    found = [name for name, marks in BENCHMARKS.items() if marks <= low]
    if len(found) != 1:
        raise ValueError(f"cannot tell the benchmark from {sorted(low)}: {found or 'none'} fit")
    return found[0]


def normal_questions(qa: DataFrame, aliases: tuple[str, ...] = ("question", "trigger", "query")) -> DataFrame:
    """question from the first alias there is, evidence as an array, category as a label."""
    labels = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    evidence = F.when(F.col("evidence").startswith("["), F.from_json("evidence", "array<string>")).when(F.col("evidence").isNotNull(), F.array("evidence")).otherwise(F.array().cast("array<string>"))
    return qa.select(
        coalesce_columns(qa, aliases).alias("question"),
        F.coalesce(*(F.col(c) for c in ("answer", "adversarial_answer") if c in qa.columns), F.lit("")).alias("answer"),
        evidence.alias("evidence"),
        F.coalesce(labels[F.col("category").cast("int")], F.lit("Unknown")).alias("category"),
    )


#: Columns that tell a benchmark's files, and labels of question categories.
BENCHMARKS = {"dialogue": {"sample", "category_label"}, "haystack": {"question_id", "question_type"}}
CATEGORIES = {1: "multi_hop", 2: "temporal", 3: "open_domain", 4: "single_hop", 5: "adversarial"}


def coalesce_columns(df: DataFrame, aliases: tuple[str, ...]) -> Column:
    """The first of the aliases that the table has, compared without case and byte-order mark; their coalesce if there are several."""
    by = {c.lstrip("﻿").lower(): c for c in df.columns}
    found = [F.col(f"`{by[a.lower()]}`") for a in aliases if a.lower() in by]
    if not found:
        raise ValueError(f"none of {aliases} in {df.columns}")
    return F.coalesce(*found)


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key, as append-only logs are read."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def runs(spark: SparkSession, root: str, suffix: str = "*.csv") -> DataFrame:
    """path, run, sample of the files of run directories, main files only."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root).select("path", "length")
    main = found.filter(~F.col("path").rlike("_(judged|summary|progress|all_answers)\\.csv$"))
    return main.select("path", "length", F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract("path", "/([^/]+)\\.[^/.]+$", 1).alias("sample"))


def held_to_pins(digests: DataFrame, pins: dict[str, str]) -> None:
    """Raise an error where a pinned file is missing or has another SHA-256; digests: as file_digests gives them."""
    found = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in digests.filter(F.regexp_extract("path", "([^/]+)$", 1).isin(list(pins))).collect()}
    wrong = sorted(n for n, d in pins.items() if found.get(n) != d.lower())
    if wrong:
        raise ValueError(f"not as pinned: {wrong}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of files, to hold against pinned ones."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def cached_keywords(questions: DataFrame, cache: DataFrame, prompt: str) -> DataFrame:
    """Keywords of a replay table by the SHA-256 of the prompt; none if absent."""
    return questions.withColumn("_k", F.sha2(F.col(prompt), 256)).join(cache.select(F.col("key").alias("_k"), "keywords"), "_k", "left").drop("_k").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
