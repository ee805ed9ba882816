"""JSON Lines in, JSON Lines and reports out; schemas are always given, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.inventory import first_per_key


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """Rows of JSON Lines; blank lines are skipped; a malformed line raises, or gives nulls when not ``strict``."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(path)


def is_there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_if_there(spark: SparkSession, path: str | None, schema: StructType | str) -> DataFrame:
    """As ``read_jsonl``; a missing file or no path is an empty table."""
    if path and is_there(spark, path):
        return read_jsonl(spark, path, schema)
    return spark.createDataFrame([], schema)


def named_inputs(spark: SparkSession, inputs: list[str], schema: StructType | str, column: str = "corpus_source") -> DataFrame:
    """``NAME=PATH`` inputs as one table with the name of each row's input; the name defaults to the file's stem."""
    frames = []
    for item in inputs:
        name, eq, path = item.partition("=")
        path = path if eq else item
        name = name if eq else path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        frames.append(read_jsonl(spark, path, schema).withColumn(column, F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_windows(spark: SparkSession, pattern: str, schema: StructType | str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """All files of a glob with their path, without the window folders named in ``excluded``."""
    rows = spark.read.schema(schema).json(pattern).withColumn("file", F.col("_metadata.file_path"))
    for name in excluded:
        rows = rows.where(~F.col("file").contains(f"/{name}/"))
    return rows


def read_tags(spark: SparkSession, path: str | list[str], schema: StructType | str, per_provider: bool = True) -> DataFrame:
    """Tags with the provider of the file name before its first dot, the first row per (provider,) entity_id."""
    rows = read_jsonl(spark, path, schema)
    rows = rows.withColumn("file", F.col("_metadata.file_name")).withColumn("provider", F.split_part("file", F.lit("."), F.lit(1)))
    keys = ["provider", "entity_id"] if per_provider else ["entity_id"]
    rest = [F.col(c) for c in rows.columns if c not in (*keys, "file")]
    return first_per_key(rows, keys, F.col("file"), *rest).drop("file")


def first_not_null(names: dict[str, list[str]]) -> list[Column]:
    """Alternative spellings of columns coalesced: ``{"left": ["left", "original_context"]}``."""
    return [F.coalesce(*[F.col(c) for c in alternatives]).alias(name) for name, alternatives in names.items()]


def parsed_answer(content: Column, schema: str) -> Column:
    """A model's answer: without code fence, cut from the first { to the last }; null if it isn't JSON."""
    return F.from_json(F.nullif(F.regexp_extract(content, r"(?s)\{.*\}", 0), F.lit("")), schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines with explicit nulls."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the output lacks, so that a run can be repeated after a break."""
    done = read_if_there(df.sparkSession, path, df.schema).select(key)
    write_jsonl(df.join(done, key, "left_anti"), path, "append")


def split_round_robin(df: DataFrame, id: str, n: int, seed: str = "41") -> DataFrame:
    """``df`` with ``part`` 0..n-1: row k in the order of a hash of ``id`` goes to part k mod n, whatever the layout of the input.

    Ranks are exact and found in parts, so parts differ by at most one row and no task ranks all.
    """
    from ..operators.splitting import hash_ranked

    one = df.withColumn("_all", F.lit(0))
    counts = one.groupBy("_all").agg(F.count("*").alias("n"))
    return hash_ranked(one, ["_all"], id, counts, seed).withColumn("part", (F.col("rank") % n).cast("int")).drop("rank", "_all")


def write_splits(df: DataFrame, path: str, split: str = "split", reviewed: int | None = None) -> None:
    """Rows by split, one folder each; of the split ``review`` at most ``reviewed`` rows, in the order of their hash."""
    if reviewed is not None:
        review = F.coalesce(F.col(split) == "review", F.lit(False))
        few = df.where(review).orderBy(F.xxhash64(*df.columns)).limit(reviewed)
        df = df.where(~review).unionByName(few)
    df.write.mode("overwrite").partitionBy(split).option("ignoreNullFields", "false").json(path)


def write_metadata(spark, path: str, values: dict[str, str]) -> None:
    """A table of keys and values beside an output: given keys replace theirs, the others stay."""
    old = {r["key"]: r["value"] for r in read_if_there(spark, path, "key string, value string").collect()}
    rows = sorted({**old, **{k: str(v) for k, v in values.items()}}.items())
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(path)


def entity_ids(tags: DataFrame, group: str | None = None, limit: int | None = None) -> DataFrame:
    """``entity_id``: ids of tag rows, each once, in the order of their first row; of one group and at most ``limit`` if stated."""
    rows = tags.where(F.col("coarse_group") == group) if group else tags
    first = rows.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min("place").alias("place"))
    return (first.orderBy("place", "entity_id").limit(limit) if limit is not None else first).select("entity_id")


# Scores that a bare label stands for.
DEFAULT_SCORES = {"changed": 0.0, "uncertain": 0.5, "preserved": 1.0}


def parsed_judgments(rows: DataFrame, key: str, content: str) -> DataFrame:
    """``key, pair_id, label, score``: the judgments in an answer, as objects in ``results`` or as a compact map of pair to label.

    Code fences and talk around the JSON are dropped; labels are folded to lower case; a missing score is that of the label; answers
    that aren't JSON, and labels that aren't known, give no row.
    """
    text = F.nullif(F.regexp_extract(content, r"(?s)\{.*\}", 0), F.lit(""))
    full = F.from_json(text, "results array<struct<pair_id:string,label:string,score:double>>")["results"]
    compact = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda x: F.struct(x["key"].alias("pair_id"), x["value"].alias("label"), F.lit(None).cast("double").alias("score")))
    found = rows.select(key, F.inline(F.coalesce(full, compact))).withColumn("label", F.lower(F.trim("label"))).where(F.col("label").isin(*DEFAULT_SCORES))
    known = F.create_map(*[F.lit(x) for pair in DEFAULT_SCORES.items() for x in pair])
    return found.select(key, "pair_id", "label", F.coalesce("score", known[F.col("label")]).alias("score"))


def markdown(df: DataFrame, group: str, per_group: int, order: Column) -> str:
    """A short report: a table of the first rows of every group."""
    from ..operators.inventory import top_per_group

    columns = [c for c in df.columns if c != group]
    lines = []
    for row in top_per_group(df, [group], per_group, order).orderBy(group, "rank").collect():
        if not lines or lines[-1][0] != row[group]:
            lines += [(row[group], f"\n## {row[group]}\n"), (row[group], "| " + " | ".join(columns) + " |"), (row[group], "|" + "-|" * len(columns))]
        cells = (str(row[c]).replace("|", "\\|").replace("\n", " ") for c in columns)
        lines.append((row[group], "| " + " | ".join(cells) + " |"))
    return "\n".join(text for _, text in lines)


def manifest(df: DataFrame, fields: list[str]) -> DataFrame:
    """One JSON value: rows, and the counts of every value of the fields."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("value")) for c in fields]))
    counts = df.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    maps = counts.groupBy("field").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n"))))).alias("json"), F.sum("n").alias("rows")
    )
    one = maps.agg(F.sort_array(F.collect_list(F.struct("field", "json"))).alias("fields"), F.max("rows").alias("rows"))
    inner = F.array_join(F.transform("fields", lambda x: F.concat(F.lit('"'), x["field"], F.lit('":'), x["json"])), ",")
    return one.select(F.concat(F.lit('{"rows":'), F.coalesce("rows", F.lit(0)).cast("string"), F.lit(',"fields":{'), inner, F.lit("}}")).alias("manifest"))
