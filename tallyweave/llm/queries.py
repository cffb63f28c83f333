"""Queries of the problems tagged llm, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .matching import match_documents, match_entities
from .mixture import mixture
from .names import parsed
from .passages import held_items
from .people import identify, kept_email, usable_phone
from .stuffed import stuffed_documents
from .survivors import survivors
from .variants import name_classes, name_variants


def _records(spark: SparkSession, d: str, tab: str, rid: str, name: str, email: str, phone: str | None, pid: str | None) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, d, tab).select(
        F.lit(tab).alias("tab"), F.col(rid).alias("id"), F.concat(F.lit(tab + "|"), F.col(rid)).alias("rec"), F.col(name).alias("name"), F.col(email).alias("email"),
        (F.col(phone) if phone else none).alias("phone"), (F.col(pid) if pid else none).alias("pid"),
    )


def people_records(spark: SparkSession, d: str) -> DataFrame:
    """All records of the four tables that carry names, as one table."""
    return (
        _records(spark, d, "meta_leads", "lead_id", "full_name", "email", "phone", None)
        .unionByName(_records(spark, d, "ghl_opportunities", "opp_id", "contact_name", "email", "phone", None))
        .unionByName(_records(spark, d, "giving_gifts", "gift_id", "donor_name", "donor_email", None, "pco_person_id"))
        .unionByName(_records(spark, d, "pco_people", "pco_person_id", "name", "email", "phone", "pco_person_id"))
    )


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Groups of duplicate people and the surviving value of each field."""
    people = table(spark, d, "pursuit_people")
    rec = people.select(F.col("id").alias("rec"), F.col("display_name").alias("name"), "email", "phone", F.col("pco_person_id").alias("pid"))
    # A person of this table has one phone: of 17 pairs of records of one name and two phones (sf0.1, check_s), none had the same person id.
    who = identify(rec, one_phone=True).select(F.col("rec").alias("id"), "entity").distinct()
    trust = table(spark, d, "trusted_sources").groupBy("source").agg(F.min("trust").alias("trust"))
    rows = people.select("id", "display_name", "email", "phone", "source", "first_seen_at", "last_signal_at", "created_at").join(who, "id").join(trust, "source", "left")
    # Names are taken apart once each, however many records carry them.
    names = people.select("display_name").where("display_name is not null").distinct().withColumn("p", parsed(F.col("display_name")))
    words = F.trim(F.col("display_name")).rlike(r"\S[\s,]+\S") & ~F.col("display_name").rlike(r"[0-9@]")
    rows = rows.join(names, "display_name", "left")
    name = F.when(words & (F.col("p.kind") == "person") & (F.length("p.g1") > 1) & (F.length("p.f1") > 1), F.col("display_name"))
    seen = F.col("first_seen_at")
    seen = F.when((F.to_date(seen) != F.lit("1970-01-01").cast("date")) & ~F.coalesce(seen > F.col("created_at"), F.lit(False)), seen)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    belief = [F.col("trust"), -micros(F.col("last_signal_at"))]
    return survivors(rows, "entity", "id", {
        "email": (kept_email(F.col("email")), belief),
        "phone": (F.when(usable_phone(F.col("phone")).isNotNull(), F.col("phone")), belief),
        "display_name": (name, belief),
        "first_seen_at": (seen, [micros(seen)]),
    })


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_survivors(spark, d).select("group_id", "field_name", "source_id")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of names with at least two spellings: the smallest spelling and each of them."""
    rows = name_classes(people_records(spark, d))
    several = rows.where("name <> spelling").select("key").distinct()
    return rows.join(several, "key", "left_semi").select("spelling", "name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants(people_records(spark, d))


def contact_records(spark: SparkSession, d: str) -> DataFrame:
    """``people_records`` with ``takes_part``: gifts with a person id only lend spellings and evidence."""
    return people_records(spark, d).withColumn("takes_part", (F.col("tab") != "giving_gifts") | F.col("pid").isNull())


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matched documents of two tables, each named by its smallest record id, with score, confidence and records on both sides."""
    pairs, members = match_documents(contact_records(spark, d))
    size = members.groupBy("tab", "doc").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    side = lambda x: size.select(F.col("tab").alias(f"table_{x}"), F.col("doc").alias(f"doc_{x}"), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"records_{x}"))
    return pairs.join(side("a"), ["table_a", "doc_a"]).join(side("b"), ["table_b", "doc_b"]).select("table_a", "id_a", "records_a", "table_b", "id_b", "records_b", "score", "confidence")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return match_entities(contact_records(spark, d)).select("table_a", "id_a", "table_b", "id_b")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return held_items(table(spark, d, "documents"), table(spark, d, "eval_items")).distinct()


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is taken."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in that mixture."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_documents(table(spark, d, "documents")).select("doc_id").distinct()


QUERIES = {
    "p2_found": p2_found, "p2_survivors": p2_survivors, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_matches": p4_matches,
    "p6_found": p6_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found,
}
ORACLE: dict[str, str] = {}
