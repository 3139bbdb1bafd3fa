"""Convention entries from JSON files, and to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.functions.languages import known_language

RULE = "id string, language string, type string, query string, message string, capture string, regex string, scope_query string, severity string, analyzer string"
#: Entries of a category that one row holds, about.
PAGE = 10_000
#: Metadata stays text until it is normalized: its values are single or lists.
SCHEMA = f"id string, kind string, language string, title string, guideline string, metadata string, rule struct<{RULE.replace(' string', ':string')}>, good_example string, bad_example string"


def metadata_map(metadata: Column) -> Column:
    """map<string, array<string>> of a JSON object: a single value becomes a list of one, null values go."""
    raw = F.from_json(metadata, "map<string,string>")
    lists = F.transform_values(raw, lambda _, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))
    return F.coalesce(F.map_filter(lists, lambda k, v: F.get(v, F.lit(0)).isNotNull() | (F.size(v) == 0)), F.create_map().cast("map<string,array<string>>"))


def read(spark: SparkSession, path: str, files: str = "*.json") -> DataFrame:
    """[I1, I2, D2] Entries of the files under path, each a list or one object in JSON, with their file. Kind is rule if a
    rule is given, else pattern; the title defaults to the id; a rule takes its entry's language and an error's severity.

    What can't be read does not stop the rest: an unknown language is null with its name in declared, and a file that is
    not JSON gives a row with broken set; quarantined tells them from good entries."""
    raw = spark.read.schema(f"{SCHEMA}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", files).json(path)
    language = known_language(F.col("language"))
    rule = F.when(F.col("rule").isNotNull(), F.col("rule").withField("language", language).withField("severity", F.coalesce("rule.severity", F.lit("error"))))
    return raw.select(
        "id",
        F.coalesce("kind", F.when(F.col("rule").isNotNull(), "rule").otherwise("pattern")).alias("kind"),
        language.alias("language"),
        F.coalesce("title", "id").alias("title"),
        F.coalesce("guideline", F.lit("")).alias("guideline"),
        metadata_map(F.col("metadata")).alias("meta"),
        rule.alias("rule"),
        "good_example",
        "bad_example",
        F.col("_metadata.file_path").alias("file"),
        F.col("language").alias("declared"),
        F.col("_corrupt_record").isNotNull().alias("broken"),
    )


def listed(entries: DataFrame, languages: tuple[str, ...] | None = None, kind: str | None = None) -> DataFrame:
    """[I9] By language and kind, in the order of ids."""
    of = entries if languages is None else entries.where(F.col("language").isin(*languages))
    of = of if kind is None else of.where(F.col("kind") == kind)
    return of.orderBy("id")


def quarantined(entries: DataFrame) -> DataFrame:
    """[S1] entries with error: null, or why the entry can't be kept."""
    reason = (
        F.when(F.col("broken"), "not JSON")
        .when(F.col("id").isNull() | (F.col("id") == ""), "no id")
        .when(F.col("language").isNull(), F.concat(F.lit("unknown language "), F.coalesce("declared", F.lit("(none)"))))
        .when(~F.col("kind").isin("rule", "pattern"), "unknown kind")
        .when((F.col("kind") == "rule") & F.col("rule").isNull(), "a rule entry needs a rule")
        .when((F.col("kind") == "pattern") & (F.coalesce("good_example", F.lit("")) == ""), "a pattern needs a good example")
    )
    return entries.withColumn("error", reason)


def export(entries: DataFrame) -> DataFrame:
    """[I10] One JSON text for each entry."""
    own = ("file", "fingerprint", "declared", "broken", "error")
    return entries.select(F.to_json(F.struct(*(c for c in entries.columns if c not in own))).alias("value"))


def exported_groups(entries: DataFrame, path: str, *, category: str = "category") -> bool:
    """[I13] One JSON text for each page of a category under path, the largest category first, with its entries in order of
    their ids; false, and nothing is written, if an entry has an error."""
    if not entries.where("error is not null").isEmpty():
        return False
    rows = groups(entries, category=category)
    rows.select(F.to_json(F.struct("slug", "page", "pages", "count", "languages", "entries")).alias("value"), "count", "slug", "page").orderBy(F.desc("count"), "slug", "page").select("value").write.mode("overwrite").text(path)
    return True


def groups(entries: DataFrame, *, category: str = "category") -> DataFrame:
    """[C9, I14] (slug, page, pages, count, rules, patterns, languages, entries) of each category of the metadata; entries
    without one, or with an empty list of them, are uncategorized. A category of over PAGE entries goes on several pages
    of about that many, dealt by a hash of their ids, so that none has to fit a task as a whole."""
    slug = F.coalesce(F.nullif(F.get(F.col("meta")[category], F.lit(0)), F.lit("")), F.lit("uncategorized"))
    row = F.struct("id", "kind", "language", "title", "guideline", "good_example", "bad_example")
    of = entries.select(slug.alias("slug"), row.alias("entry"))
    per = of.groupBy("slug").agg(F.count("*").alias("count"), F.count_if(F.col("entry.kind") == "rule").alias("rules"), F.count_if(F.col("entry.kind") == "pattern").alias("patterns"), F.array_sort(F.collect_set("entry.language")).alias("languages"))
    per = per.withColumn("pages", F.ceil(F.col("count") / PAGE).cast("int"))
    # dealt out anew, so that the join can split a category of very many entries
    own = per.select("slug", "pages").repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    paged = of.join(own, "slug").groupBy("slug", F.pmod(F.xxhash64("entry.id"), F.col("pages")).cast("int").alias("page")).agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return paged.join(per, "slug").select("slug", "page", "pages", "count", "rules", "patterns", "languages", "entries")
