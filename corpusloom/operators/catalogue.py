"""Course catalogue pages: which unit an address belongs to, and which of its chunks come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.functions import rules, text, urls
from corpusloom.operators import retrieval
from corpusloom.operators.order import placed


def unit_state(pages: DataFrame, hints: DataFrame) -> DataFrame:
    """pages: url, entity; hints: entity, unit, sub_unit. Adds state: true if the address names a unit or a sub-unit of the
    entity, false if it names others only, null if it names none or nothing is known of the entity."""
    known = retrieval.with_units(pages, hints, F.col("entity"))
    return known.withColumn("state", retrieval.unit_match(F.col("url"), F.col("units"), F.col("sub_units"))).drop("units", "sub_units")


def of_units(pages: DataFrame, hints: DataFrame) -> DataFrame:
    """Pages whose address names one of the hinted units in either spelling of the parameter."""
    unit = F.coalesce(urls.parameter(F.col("url"), "curSunit"), urls.parameter(F.col("url"), "curUnit"))
    return pages.join(hints.select(F.col("sub_unit").alias("_u")).union(hints.select("unit")).distinct(), unit == F.col("_u"), "left_semi")


def number_first(url: Column) -> list[Column]:
    """Sort keys: addresses with a numeric sub-unit in order of the number, then the others."""
    digits = F.regexp_extract(url, "(?i)[?&]cursunit=([0-9]+)", 1)
    number = F.when(digits != "", digits.try_cast("long"))
    return [number.isNull(), number]


def course_chunks(chunks: DataFrame, wanted: Column, most: int = 24) -> DataFrame:
    """The first chunks that are wanted, by number of their unit, then by id."""
    order = [*number_first(F.col("source_url")), F.col("chunk_id")]
    top = chunks.where(wanted).orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order)))


def fallback_chunks(questions: DataFrame, chunks: DataFrame, site: rules.Site = rules.Site(), most: int = 5, scanned: int = 120) -> DataFrame:
    """Catalogue chunks for questions about courses that were left without any: course tabs first, then those that name
    the entity in their address, then in their text, by id. Of a question's entity the first `scanned` chunks are looked at;
    questions of no entity get none."""
    asked = questions.where(rules.intent(F.col("question"), "catalogue")).select("query_id", rules.entity(F.col("question")).alias("entity"))
    # a chunk belongs to each of the fixed entities that its address or text names, so that questions meet it by an equi-join
    catalogued = chunks.where(rules.has(F.col("source_url"), site.catalogue)).withColumn("_low", text.fold(F.coalesce("content", F.lit(""))))
    about = [F.struct(F.lit(k).alias("entity"), F.contains(F.lower("source_url"), F.lit(k)).alias("named"), rules.contains_any(F.col("_low"), names).alias("alias")) for k, names in rules.ENTITIES.items()]
    rows = catalogued.select("chunk_id", "source_url", F.explode(F.filter(F.array(*about), lambda x: x["named"] | x["alias"])).alias("x")).select("chunk_id", "source_url", "x.*")
    pool = rows.withColumn("_n", F.row_number().over(W.partitionBy("entity").orderBy("chunk_id"))).where(F.col("_n") <= scanned)
    keys = [rules.has(F.col("source_url"), "course").desc(), F.desc("named"), F.desc("alias"), F.col("chunk_id")]
    best = pool.withColumn("place", F.row_number().over(W.partitionBy("entity").orderBy(*keys))).where(F.col("place") <= most)
    return asked.join(best, "entity").select("query_id", "chunk_id", "place")


def host_pool(questions: DataFrame, chunks: DataFrame, host: str, most: int = 64) -> DataFrame:
    """Nearest chunks of one host only, to be merged into the pool."""
    return retrieval.min_merged(retrieval.nearest(questions, chunks.where(urls.host(F.col("source_url")) == host), most))


def pools_merged(pool: DataFrame, other: DataFrame) -> DataFrame:
    """Two pools of query_id, chunk_id, d_min, d_primary: the smaller distance of each candidate counts."""
    return pool.unionByName(other).groupBy("query_id", "chunk_id").agg(F.min("d_min").alias("d_min"), F.min("d_primary").alias("d_primary"))


def pinned_first(pages: DataFrame, index_url: str) -> DataFrame:
    """Addresses in order with the index in front."""
    return placed(pages.select("url").distinct(), F.col("url") != index_url, F.col("url"))


def menu_ranked(labels: DataFrame, tiers: list[list[str]]) -> DataFrame:
    """labels: label. Entries of a menu by the first tier one of whose words they contain, then by that word's place."""
    low = text.fold(F.col("label"))
    hit = F.lit(None)
    for t in range(len(tiers) - 1, -1, -1):
        for w in range(len(tiers[t]) - 1, -1, -1):
            hit = F.when(F.contains(low, F.lit(tiers[t][w])), F.struct(F.lit(t).alias("tier"), F.lit(w).alias("word"))).otherwise(hit)
    ranked = labels.withColumn("_hit", hit).where("_hit is not null").select("label", "_hit.tier", "_hit.word")
    return placed(ranked, F.col("tier"), F.col("word"), F.col("label"))


def person_pages(pages: DataFrame, name: str, most: int = 8, window: int = 7000, total: int = 14_000) -> DataFrame:
    """Pages that name a person: staff pages first, longer addresses first, and of each a window around the name, as long
    as all together stay in their bound."""
    named = pages.where(rules.name_in(F.concat_ws("\n", "title", "content"), F.lit(name)))
    head = F.concat_ws("\n", "url", "title")
    bucket = F.when(rules.has(head, rules.HIGH_SIGNAL), 0).when(rules.has(head, rules.LOW_SIGNAL), 2).otherwise(1)
    order = [F.col("bucket"), F.desc(F.length("url")), F.col("page_id")]
    top = named.withColumn("bucket", bucket).orderBy(*order).limit(most).withColumn("place", F.row_number().over(W.orderBy(*order)))
    top = top.withColumn("part", text.snippet(F.col("content"), F.lit(name), window))
    used = F.sum(F.length("part")).over(W.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    return top.withColumn("used", used).where(F.col("used") <= total).select("page_id", "url", "bucket", "place", "part")
