"""Flattening of saved API answers to one record schema, by a registry of shapes.

Answers are parsed as VARIANT, so a field of another type or a missing level is null and costs no other field; answers that
can't be read become rows of a side table with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.ids import canonical_id
from sievework.functions.text import clean_abstract, once

RECORD = ("doi", "title", "authors", "year", "journal", "abstract", "type", "page")


def inverted_abstract(index: Column) -> Column:
    """An abstract from its map of words to positions."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["w"]), " ")


def inverted_index(text: Column) -> Column:
    """A text as the map of its words to their positions; null stays null. The words of a text are sorted within its row."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))))

    def entries(p: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i)["w"] != F.get(p, i - 1)["w"]))
        return once(F.concat(first, F.array(F.size(p))), lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda k: F.struct(F.get(p, F.get(s, k))["w"].alias("w"), F.transform(F.slice(p, F.get(s, k) + 1, F.get(s, k + 1) - F.get(s, k)), lambda x: x["at"]).alias("at"))))

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<int>>"))
    return once(placed, lambda p: F.when(F.size(p) > 0, F.map_from_entries(entries(p))).when(p.isNotNull(), none))


def at(value: Column, path: str, kind: str = "string") -> Column:
    """What lies at a path of a VARIANT, as ``kind``; null if it isn't there or isn't of the kind."""
    return F.try_variant_get(value, f"$.{path}" if path[0] != "[" else f"${path}", kind)


def words_at(value: Column, *paths: str) -> Column:
    """The first text with a sign at the paths, its white space single; a text may be wrapped as {"$": text}."""
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    plain = lambda p: F.when(at(value, p, "map<string,variant>").isNull() & at(value, p, "array<variant>").isNull(), at(value, p))
    return F.coalesce(*[tidy(c) for p in paths for c in (at(value, p + '["$"]'), plain(p))])


def joined(value: Column, path: str, text: Callable[[Column], Column]) -> Column:
    """The texts that ``text`` makes of an array's elements, those with a sign, by semicolons."""
    return F.array_join(F.filter(F.transform(at(value, path, "array<variant>"), text), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), "; ")


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, r"\d{4}", 0)


def person(given: str, family: str, whole: str) -> Callable[[Column], Column]:
    return lambda a: F.coalesce(F.nullif(F.concat_ws(" ", words_at(a, given), words_at(a, family)), F.lit("")), words_at(a, whole))


def listed(*paths: str) -> Callable[[Column], Column]:
    """The records of an answer: the array at the first path that has one."""
    return lambda v: F.coalesce(*[at(v, p, "array<variant>") for p in paths])


def single(*paths: str) -> Callable[[Column], Column]:
    """The one record of an answer: what lies at the first path that has something, else the answer itself."""
    return lambda v: F.array(F.coalesce(*[at(v, p, "variant") for p in paths], v))


def nested_id(node: Column, depth: int = 6) -> Column:
    """The first text of the shape of an identifier under a key that names one, nearest to the top."""
    text = lambda e: F.coalesce(at(e["value"], '["$"]'), at(e["value"], "value"), at(e["value"], "[0]"), F.try_variant_get(e["value"], "$", "string"))
    inside = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<variant>"))
    found, level = [], F.array(node)
    for _ in range(depth + 1):
        entries = F.flatten(F.filter(F.transform(level, lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))), lambda e: e.isNotNull()))
        ids = F.transform(F.filter(entries, lambda e: F.lower(e["key"]).contains("doi")), lambda e: F.trim(text(e)))
        found.append(F.get(F.filter(ids, lambda x: x.rlike(r"(?i)^(?:https?://(?:dx\.)?doi\.org/)?10\.\d{4,9}/\S+$")), 0))
        level = F.flatten(F.transform(level, inside))
    return F.coalesce(*found)


class Provider(NamedTuple):
    """Where the records of a provider's answer are, and what they say."""

    records: Callable[[Column], Column]
    fields: Callable[[Column], dict[str, Column]]


#: Provider to the shape of its saved answers.
PROVIDERS: dict[str, Provider] = {
    "crossref": Provider(single("message"), lambda r: {
        "doi": at(r, "DOI"), "title": words_at(r, "title[0]"), "authors": joined(r, "author", person("given", "family", "name")),
        "year": F.coalesce(at(r, 'issued["date-parts"][0][0]'), at(r, 'published["date-parts"][0][0]')), "journal": words_at(r, '["container-title"][0]'), "abstract": clean_abstract(at(r, "abstract")), "type": at(r, "type"), "page": at(r, "page")}),
    "europepmc": Provider(listed("resultList.result"), lambda r: {
        "doi": at(r, "doi"), "title": words_at(r, "title"), "authors": words_at(r, "authorString"), "year": at(r, "pubYear"), "journal": words_at(r, "journalTitle", "journalInfo.journal.title"), "abstract": clean_abstract(at(r, "abstractText")), "type": at(r, "pubType"), "page": at(r, "pageInfo")}),
    "semanticscholar": Provider(single(), lambda r: {
        "doi": at(r, "externalIds.DOI"), "title": words_at(r, "title"), "authors": joined(r, "authors", lambda a: words_at(a, "name")), "year": at(r, "year"), "journal": words_at(r, "venue"), "abstract": clean_abstract(at(r, "abstract"))}),
    "openalex": Provider(lambda v: F.coalesce(at(v, "results", "array<variant>"), F.array(v)), lambda r: {
        "doi": at(r, "doi"), "title": words_at(r, "title", "display_name"), "authors": joined(r, "authorships", lambda a: words_at(a, "author.display_name")), "year": at(r, "publication_year"),
        "journal": words_at(r, "primary_location.source.display_name"), "abstract": inverted_abstract(at(r, "abstract_inverted_index", "map<string,array<int>>")), "type": at(r, "type")}),
    "datacite": Provider(single("data.attributes"), lambda r: {
        "doi": at(r, "doi"), "title": words_at(r, "titles[0].title"), "authors": joined(r, "creators", person("givenName", "familyName", "name")), "year": at(r, "publicationYear"), "journal": words_at(r, "publisher", "publisher.name"),
        "abstract": F.get(F.filter(F.transform(at(r, "descriptions", "array<variant>"), lambda d: clean_abstract(at(d, "description"))), lambda d: d != ""), 0), "type": at(r, "types.resourceTypeGeneral")}),
    "pubmed": Provider(lambda v: F.map_values(F.map_filter(at(v, "result", "map<string,variant>"), lambda k, x: (k != "uids") & at(x, "error").isNull())), lambda r: {
        "doi": F.get(F.filter(F.transform(at(r, "articleids", "array<variant>"), lambda i: F.when(at(i, "idtype") == "doi", at(i, "value"))), lambda x: x.isNotNull()), 0),
        "title": words_at(r, "title"), "authors": joined(r, "authors", lambda a: words_at(a, "name")), "year": first_year(at(r, "pubdate")), "journal": words_at(r, "fulljournalname", "source"), "page": at(r, "pages")}),
    "lilacs": Provider(listed("objects"), lambda r: {
        "doi": at(r, "doi_number"), "title": words_at(r, "title[0].text", "title[0]", "title.text", "title"), "authors": joined(r, "individual_author", lambda a: F.coalesce(words_at(a, "text"), F.when(F.try_variant_get(a, "$", "map<string,variant>").isNull(), F.try_variant_get(a, "$", "string")))),
        "year": first_year(words_at(r, "publication_date_normalized", "publication_date")), "journal": words_at(r, "title_serial", "source"), "abstract": clean_abstract(words_at(r, "abstract[0].text", "abstract[0]"))}),
    "entries": Provider(lambda v: F.filter(listed('["search-results"].entry', "results", "entries")(v), lambda e: at(e, "error").isNull()), lambda r: {
        "doi": nested_id(r), "title": words_at(r, '["dc:title"]', "title", "citationTitle", "head.citationTitle", "head.title", "itemInfo.citationTitle", "itemInfo.title"), "authors": words_at(r, '["dc:creator"]'),
        "year": F.left(words_at(r, '["prism:coverDate"]', "publicationYear", "year", "head.publicationYear", "itemInfo.publicationYear"), F.lit(4)),
        "journal": words_at(r, '["prism:publicationName"]', "sourceTitle", "journal", "head.source.sourceTitle", "itemInfo.source.sourceTitle"), "abstract": clean_abstract(words_at(r, '["dc:description"]')), "page": words_at(r, '["prism:pageRange"]')}),
}


def answers(raw: DataFrame, provider: str) -> DataFrame:
    """``raw`` (a column ``payload``) with its ``records`` as an array of VARIANT, and why there are none in ``reason``."""
    parsed = raw.withColumn("answer", F.try_parse_json("payload")).withColumn("records", PROVIDERS[provider].records(F.col("answer")))
    # An answer that isn't an object, or whose records aren't, says nothing.
    objects = F.filter("records", lambda r: F.try_variant_get(r, "$", "map<string,variant>").isNotNull())
    parsed = parsed.withColumn("records", F.coalesce(objects, F.array().cast("array<variant>"))).withColumn("records", F.filter("records", lambda r: F.size(F.try_variant_get(r, "$", "map<string,variant>")) > 0))
    empty = F.trim(F.coalesce("payload", F.lit(""))) == ""
    return parsed.withColumn("reason", F.when(empty, "empty").when(F.col("answer").isNull(), "not JSON").when(F.size("records") == 0, "no records"))


def split_answers(raw: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """The records of saved answers, and the answers without any: (source, reason, payload). Both read the parsed answers.

    A filter on the parsed answers, also the one that Spark sets below an inner explode, would be moved below the parsing and
    parse each answer once for each mention; outer explodes keep their filters above them.
    """
    parsed = answers(raw, provider)
    rows = parsed.select(F.explode_outer("records").alias("r")).filter("r IS NOT NULL")
    fields = PROVIDERS[provider].fields(F.col("r"))
    text = lambda c: F.coalesce(F.trim(fields[c]), F.lit("")) if c in fields else F.lit("")
    good = rows.select(F.lit(provider).alias("source"), *[(canonical_id(fields[c]) if c == "doi" else text(c)).alias(c) for c in RECORD])
    none = parsed.select("payload", "reason", F.explode_outer(F.slice("records", 1, 1)).alias("r")).filter("r IS NULL")
    return good, none.select(F.lit(provider).alias("source"), "reason", "payload")


def source_records(raw: DataFrame, provider: str) -> DataFrame:
    """The records of saved answers in one schema."""
    return split_answers(raw, provider)[0]


def open_locations(raw: DataFrame) -> DataFrame:
    """(doi, pdf_urls, page_urls): the best location first; pages never repeat a file."""
    place = "struct<url_for_pdf:string,url_for_landing_page:string,url:string>"
    r = raw.select(F.from_json("payload", f"doi string, best_oa_location {place}, oa_locations array<{place}>").alias("r")).select("r.*")
    everywhere = F.concat(F.array("best_oa_location"), F.coalesce("oa_locations", F.array().cast(f"array<{place}>")))
    there = F.filter(everywhere, lambda x: x.isNotNull())
    pdfs = F.array_distinct(F.filter(F.transform(there, lambda x: x["url_for_pdf"]), lambda u: u.isNotNull()))
    pages = F.array_distinct(F.filter(F.transform(there, lambda x: F.coalesce(x["url_for_landing_page"], x["url"])), lambda u: u.isNotNull()))
    return r.select(canonical_id(F.col("doi")).alias("doi"), pdfs.alias("pdf_urls"), F.array_except(pages, pdfs).alias("page_urls"))


def read_pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, journal, year, doi) of article sets; unreadable parts are dropped by the permissive reader."""
    ids = "ArticleIdList: struct<ArticleId: array<struct<_IdType:string,_VALUE:string>>>"
    date = "struct<Year:string,MedlineDate:string>"
    schema = f"MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,Journal:struct<Title:string,JournalIssue:struct<PubDate:{date}>>,ArticleDate:struct<Year:string>>>, PubmedData struct<{ids}>"
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").option("mode", "PERMISSIVE").schema(schema).load(path)
    a = F.col("MedlineCitation.Article")
    issue = a["Journal"]["JournalIssue"]["PubDate"]
    year = F.coalesce(issue["Year"], F.nullif(F.regexp_extract(issue["MedlineDate"], r"((?:19|20)\d{2})", 1), F.lit("")), a["ArticleDate"]["Year"])
    doi = F.get(F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda i: i["_IdType"] == "doi"), 0)["_VALUE"]
    pmid = F.col("MedlineCitation.PMID._VALUE")
    return rows.select(pmid.alias("pmid"), F.coalesce(a["ArticleTitle"], F.concat(F.lit("PMID "), pmid)).alias("title"), a["Journal"]["Title"].alias("journal"), year.alias("year"), canonical_id(doi).alias("doi"))


def newest_versions(keys: DataFrame) -> DataFrame:
    """(id, version, xml, pdf) of an object listing (key): files named as their folder are the article, others supplements."""
    r = keys.select("key", F.regexp_extract("key", r"(?:^|/)([A-Z]+\d+)\.(\d+)/\1\.\2\.(\w+)$", 1).alias("id"), F.regexp_extract("key", r"(?:^|/)([A-Z]+\d+)\.(\d+)/\1\.\2\.(\w+)$", 2).cast("string").alias("v"), F.lower(F.regexp_extract("key", r"\.(\w+)$", 1)).alias("ext"))
    r = r.filter("id <> ''").withColumn("version", F.col("v").try_cast("int"))
    by = r.groupBy("id", "version").agg(F.max(F.when(F.col("ext") == "xml", F.col("key"))).alias("xml"), F.max(F.when(F.col("ext") == "pdf", F.col("key"))).alias("pdf"), F.count("*").alias("files"))
    return by.groupBy("id").agg(F.max_by(F.struct("version", "xml", "pdf", "files"), "version").alias("r")).select("id", "r.*")


def crosswalk(raw: DataFrame) -> DataFrame:
    """(id, doi) for PMIDs and PMCIDs of saved id-conversion answers; records with an error are dropped."""
    rec = "struct<pmid:string,pmcid:string,doi:string,status:string,errmsg:string>"
    r = raw.select(F.explode(F.from_json("payload", f"records array<{rec}>")["records"]).alias("r")).select("r.*").filter("errmsg IS NULL AND coalesce(status, '') <> 'error'")
    return r.select(F.explode(F.array("pmid", "pmcid")).alias("id"), canonical_id(F.col("doi")).alias("doi")).filter("id IS NOT NULL AND doi IS NOT NULL").distinct()
