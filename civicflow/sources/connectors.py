"""Rows of public portals brought to one schema. Fetching is left to the caller; these are the mappings.

Ids are content hashes where a portal has none, so that reordered pages don't change them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions.text import display_name, href, html_text, short_hash

COLUMNS = ["source", "comment_id", "docket_id", "agency_id", "submitter_name", "submitter_org", "posted_date", "comment_text", "attachment_urls", "raw_metadata"]


def _row(df: DataFrame, source: str, **given: Column) -> DataFrame:
    meta = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    known = {"source": F.lit(source), "raw_metadata": meta} | given
    return df.select(*[(known[c].cast("string") if c in known else F.lit("")).alias(c) for c in COLUMNS])


def _content_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), short_hash(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def _join(items: Column, field: str) -> Column:
    return F.array_join(F.filter(F.transform(items, lambda x: x[field]), lambda x: F.coalesce(x != "", F.lit(False))), ";")


def ecfs(df: DataFrame, source: str = "fcc_ecfs") -> DataFrame:
    """Filings: filers, proceedings and documents are lists; a filing's dockets are joined by semicolons."""
    return _row(
        df, source, comment_id=F.coalesce("id_submission", F.lit("")), docket_id=_join(F.col("proceedings"), "name"), agency_id=F.lit("FCC"),
        submitter_name=F.coalesce(F.get("filers", 0)["name"], F.lit("")), posted_date=F.coalesce("date_received", "date_submission", F.lit("")),
        comment_text=F.coalesce("text_data", F.lit("")), attachment_urls=_join(F.col("documents"), "src"),
    )


def sec(df: DataFrame) -> DataFrame:
    return _row(df, "sec", comment_id=_content_id("sec", F.col("file_number"), F.col("pdf_url"), F.col("submitter")), docket_id=F.col("file_number"), agency_id=F.lit("SEC"), submitter_name=F.col("submitter"), posted_date=F.col("posted_date"), attachment_urls=F.col("pdf_url"))


def fdic(df: DataFrame) -> DataFrame:
    return _row(df, "fdic", comment_id=_content_id("fdic", F.col("rin"), F.col("pdf_url")), docket_id=F.col("rin"), agency_id=F.lit("FDIC"), submitter_name=F.col("submitter"), attachment_urls=F.col("pdf_url"))


def federal_reserve(df: DataFrame) -> DataFrame:
    """display holds ``Organisation, Name (FORMAT)``."""
    who = display_name(F.col("display"))
    return _row(df, "fed_reserve", comment_id=F.concat(F.lit("fed_"), F.col("letter_id")), docket_id=F.col("docket"), agency_id=F.lit("FRS"), submitter_name=who["name"], submitter_org=who["org"], posted_date=F.col("posted_date"), attachment_urls=F.col("pdf_url"))


def fec(df: DataFrame) -> DataFrame:
    """commenters is a list of names; a name with a comma and a space is a person's, any other an organisation's."""
    people, orgs = F.filter("commenters", lambda n: n.contains(", ")), F.filter("commenters", lambda n: ~n.contains(", "))
    cell = lambda a: F.when(F.size(a) > 0, F.array_join(a, "; "))
    return _row(df, "fec", comment_id=F.concat(F.replace(F.col("reg_number"), F.lit(" "), F.lit("_")), F.lit("_doc"), F.col("docid")), docket_id=F.col("reg_number"), agency_id=F.lit("FEC"), submitter_name=cell(people), submitter_org=cell(orgs), posted_date=F.col("date"), attachment_urls=F.col("url"))


def cara(df: DataFrame) -> DataFrame:
    """Letters of forest projects; all addresses of a letter are kept."""
    urls = F.filter(F.concat(F.array("download_url", "detail_url"), F.coalesce("attachments", F.array().cast("array<string>"))), lambda u: F.coalesce(u != "", F.lit(False)))
    return _row(df, "fs_cara", comment_id=F.concat(F.lit("cara_"), F.col("letter_id")), docket_id=F.concat(F.lit("cara_project_"), F.col("project_id")), agency_id=F.lit("USDA_FS"), submitter_name=F.col("author"), submitter_org=F.col("organization"), posted_date=F.col("date_submitted"), attachment_urls=F.array_join(urls, ";"))


def attorney_letters(df: DataFrame, source: str = "state_ag") -> DataFrame:
    """Joint letters of states: the recipient stands for both docket and agency; issue and link are HTML."""
    return _row(df, source, comment_id=_content_id(source, F.col("recipient"), F.col("datefiled"), F.col("specificissue")), docket_id=F.col("recipient"), agency_id=F.col("recipient"), submitter_name=F.lit("State Attorneys General (multistate)"), submitter_org=F.col("agsinvolved"), posted_date=F.col("datefiled"), comment_text=html_text(F.col("specificissue")), attachment_urls=href(F.col("copyofletter")))


def dump_filings(submissions: DataFrame, comments: DataFrame, filers: DataFrame, docket: str, source: str) -> DataFrame:
    """Submissions of a database dump with their text and all their filers."""
    names = filers.groupBy("submission_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("_names"))
    met = submissions.join(comments.select("comment_id", "comment_text"), "comment_id", "left").join(names, "submission_id", "left")
    return _row(met, source, comment_id=F.concat(F.lit(source + "_"), F.col("submission_id")), docket_id=F.lit(docket), agency_id=F.lit("FCC"), submitter_name=F.coalesce("_names", F.lit("")), posted_date=F.coalesce("date_received", F.lit("")), comment_text=F.coalesce("comment_text", F.lit("")))


def generic(source: str, agency: str) -> Callable[[DataFrame], DataFrame]:
    """For portals whose rows have id, docket, name, organization, date, text and url."""

    def run(df: DataFrame) -> DataFrame:
        have = lambda c: F.col(c) if c in df.columns else F.lit("")
        own = F.concat(F.lit(source + "_"), F.col("id").cast("string")) if "id" in df.columns else _content_id(source, *[F.col(c) for c in df.columns])
        return _row(df, source, comment_id=own, docket_id=have("docket"), agency_id=F.lit(agency), submitter_name=have("name"), submitter_org=have("organization"), posted_date=have("date"), comment_text=have("text"), attachment_urls=have("url"))

    return run


def point_features(df: DataFrame) -> DataFrame:
    """Attributes and coordinates of GeoJSON features, one row each. df has the column ``json``, one collection a row."""
    schema = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<double>>>>>"
    flat = df.select(F.explode(F.from_json("json", schema)["features"]).alias("f"))
    return flat.select(F.col("f.properties").alias("properties"), F.get("f.geometry.coordinates", 0).alias("lon"), F.get("f.geometry.coordinates", 1).alias("lat"))


CONNECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fcc_ecfs": ecfs, "fcc_bulk": lambda d: ecfs(d, "fcc_bulk"), "fcc_plan": lambda d: ecfs(d, "fcc_plan"), "fcc_hourly": lambda d: ecfs(d, "fcc_hourly"), "fcc_api": lambda d: ecfs(d, "fcc_api"),
    "sec": sec, "fdic": fdic, "fed_reserve": federal_reserve, "fec": fec, "fs_cara": cara, "state_ag": attorney_letters, "nyu_ag": lambda d: attorney_letters(d, "nyu_ag"),
    "regulations": generic("regulations", ""), "ferc": generic("ferc", "FERC"), "cftc": generic("cftc", "CFTC"), "cms_ncd": generic("cms_ncd", "CMS"), "pcaob": generic("pcaob", "PCAOB"),
    "nrc_adams": generic("nrc_adams", "NRC"), "usitc_edis": generic("usitc_edis", "USITC"), "usace": generic("usace", "USACE"),
}
