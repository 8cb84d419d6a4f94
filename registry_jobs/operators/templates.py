"""Mail merge: templates with {{word}} places filled from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry_jobs.functions.text import js_trim

KEYS = ("propertyName", "location", "lotNumber", "landArea", "buildingArea", "usage", "owner")

# The three templates.
TEMPLATES = (
    (
        "standard",
        "基本案内",
        "【物件情報のご案内】{{propertyName}}",
        "お世話になっております。\n\n下記物件についてご案内いたします。\n\n物件名：{{propertyName}}\n所在：{{location}}\n地番：{{lotNumber}}\n敷地面積：{{landArea}}\n建物面積：{{buildingArea}}\n用途：{{usage}}\n所有者：{{owner}}\n\nご確認よろしくお願いいたします。",
    ),
    (
        "owner",
        "所有者案内向け",
        "【所有者確認】{{propertyName}}",
        "お世話になっております。\n\n登記資料をもとに、下記のとおり整理しました。\n\n所在：{{location}}\n地番：{{lotNumber}}\n敷地面積：{{landArea}}\n所有者：{{owner}}\n\n必要であれば原本をもとに再確認いたします。",
    ),
    (
        "internal",
        "社内共有用",
        "社内共有｜{{propertyName}}",
        "社内共有です。\n\n物件名：{{propertyName}}\n所在：{{location}}\n地番：{{lotNumber}}\n土地：{{landArea}}\n建物：{{buildingArea}}\n用途：{{usage}}\n所有者：{{owner}}\n\n※ 数値・表記は原本照合を前提にしてください。",
    ),
)


def template_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template string, label string, subject string, body string")


def fill(template: Column, values: Column) -> Column:
    """Places filled once from a map; what a value holds is not read again, unknown words become empty."""
    marked = F.regexp_replace(template, r"\{\{([0-9A-Za-z_]+)\}\}", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001", -1)
    head = F.get(parts, F.lit(0))
    rest = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.concat(F.coalesce(F.try_element_at(values, F.substring_index(p, "\u0002", 1)), F.lit("")), F.substring_index(p, "\u0002", -1)),
    )
    return F.concat(head, F.array_join(rest, ""))


def apply_templates(records: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, template, subject, body) for each record and template.

    The templates ride along as one row's array, read once: they are a handful by nature and checked here.
    """
    rows = templates.select("template", "subject", "body").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 templates")
    array = F.array(*[F.struct(F.lit(r["template"]).alias("template"), F.lit(r["subject"]).alias("subject"), F.lit(r["body"]).alias("body")) for r in rows])
    values = F.create_map(*[x for k in KEYS for x in (F.lit(k), F.coalesce(F.col(k), F.lit("")))])
    out = records.select("doc_id", values.alias("v"), F.explode(array).alias("t"))
    return out.select("doc_id", "t.template", fill(F.col("t.subject"), F.col("v")).alias("subject"), fill(F.col("t.body"), F.col("v")).alias("body"))


def coverage(records: DataFrame, templates: DataFrame) -> DataFrame:
    """(template, label, places, records, complete): of each template of the catalogue the words it asks for, and how many records have them all."""
    places = F.array_distinct(F.regexp_extract_all(F.concat("subject", "body"), F.lit(r"\{\{([0-9A-Za-z_]+)\}\}"), F.lit(1)))
    rows = templates.select("template", "label", places.alias("places")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 templates")
    has = F.filter(F.array(*[F.when(js_trim(F.coalesce(F.col(k), F.lit(""))) != "", F.lit(k)) for k in KEYS]), lambda k: k.isNotNull())
    array = F.array(*[F.struct(F.lit(r["template"]).alias("template"), F.lit(r["label"]).alias("label"), F.array(*[F.lit(p) for p in r["places"]]).alias("places")) for r in rows])
    each = records.select(has.alias("has"), F.explode(array).alias("t"))
    lacks = F.size(F.array_except("t.places", "has"))
    out = each.groupBy("t.template", "t.label", F.size("t.places").cast("long").alias("places")).agg(F.count(F.lit(1)).alias("records"), F.count(F.when(lacks == 0, 1)).alias("complete"))
    return out.select("template", "label", "places", "records", "complete")
