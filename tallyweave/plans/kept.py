"""Sources, sinks and streams over the tables of the domain; what is written goes to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


from ..functions.ids import plain_id
from ..operators.latest import latest_version
from ..operators.relations import inserted_missing, replaced_groups, top, upsert
from ..runtime import new_folder
from ..sources.files import cues, json_lines, page_tables, text_files
from ..sources.mirror import Mirror, preview
from ..sources.paged import PagedSource
from ..streaming.flows import clock_state, file_stream, keep_newest, last_seen
from .book import Book, Tables
from .general import plain_sql
from .grouped import _SIGNALS, gifts, last_signal
from .scalars import NOW_AT

book = Book()
query = book.query
_GIVER = plain_sql("pco_person_id")


@query("select fund, cast(count(*) as bigint) as n, cast(sum(amount_cents) as bigint) as cents from giving_gifts group by 1")
def s1_scan(t: Tables):
    return t.giving_gifts.groupBy("fund").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents"))


@query("select distinct lead_id from meta_leads where lead_id is not null")
def s2_keys(t: Tables):
    return t.meta_leads.select("lead_id").where("lead_id is not null").distinct()


def paged(t: Tables, name: str, columns: str, schema: str, **options) -> DataFrame:
    t.spark.dataSource.register(PagedSource)
    reader = t.spark.read.format("paged").schema(schema).option("fetch", "tallyweave.sources.paged:parquet_pages").option("at", f"{t.folder}/{name}.parquet?{columns}")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


@query("select pco_person_id, name from pco_people")
def s3_offset_pages(t: Tables):
    return paged(t, "pco_people", "pco_person_id,name", "pco_person_id string, name string", page="1000")


@query("select g.group_name, cast(count(*) as bigint) as n from (select membership_id, group_id from pco_group_memberships) m join (select group_id, min(group_name) group_name from pco_group_memberships where group_name is not null group by 1) g using (group_id) group by 1")
def s4_pages_with_side_table(t: Tables):
    # Pages as they land, of some 500 memberships each, and beside them each page's own copy of the groups they name.
    m = t.pco_group_memberships
    pages = m.groupBy(F.pmod(F.xxhash64("membership_id", "synced_at"), F.lit(max(1, m.count() // 500))).alias("page")).agg(
        F.collect_list(F.struct("membership_id", "group_id")).alias("data"), F.collect_set(F.when(F.col("group_name").isNotNull(), F.struct("group_id", "group_name"))).alias("included"))
    data, side = page_tables(pages)
    return data.join(side.groupBy("group_id").agg(F.min("group_name").alias("group_name")), "group_id").groupBy("group_name").agg(F.count(F.lit(1)).alias("n"))


@query("select opp_id, stage from ghl_opportunities")
def s5_cursor_pages(t: Tables):
    return paged(t, "ghl_opportunities", "opp_id,stage", "opp_id string, stage string", by="cursor", page="500")


@query("select lead_id, campaign_id from meta_leads")
def s6_pages_with_retries(t: Tables):
    # Every page fails the first time it is asked for.
    t.spark.dataSource.register(PagedSource)
    return t.spark.read.format("paged").schema("lead_id string, campaign_id string").option("fetch", "tallyweave.plans.kept:failing_pages").option("at", f"{t.folder}/meta_leads.parquet?lead_id,campaign_id").load()


_failed: set = set()


def failing_pages(at: str, offset: int | None, size: int) -> dict:
    from ..sources.paged import Unavailable, parquet_pages

    if (at, offset, size) not in _failed:
        _failed.add((at, offset, size))
        raise Unavailable("busy", wait=0.0)
    _failed.discard((at, offset, size))
    return parquet_pages(at, offset, size)


@query("""with a as (select pco_person_id k, min(email) email from pco_people where email is not null and email <> '' group by 1), b as (select pco_person_id k, min(email) email from pursuit_people where email is not null and email <> '' and pco_person_id is not null group by 1)
 select coalesce(a.k, b.k) as pco_person_id, coalesce(a.email, b.email) as email from a full join b on a.k = b.k""")
def s7_fallback_fill(t: Tables):
    side = lambda df, name: df.where("email is not null and email <> '' and pco_person_id is not null").groupBy("pco_person_id").agg(F.min("email").alias(name))
    return side(t.pco_people, "a").join(side(t.pursuit_people, "b"), "pco_person_id", "full_outer").select("pco_person_id", F.coalesce("a", "b").alias("email"))


@query("select title, cast(count(*) as bigint) as n from documents where title is not null and title <> '' group by 1")
def s8_text_files(t: Tables):
    # Written as files of text, read again whole.
    folder = new_folder(t.spark, "texts")
    t.documents.where("title is not null and title <> ''").select("title").write.text(f"{folder}/deep/er")
    lines = text_files(t.spark, folder).select(F.explode(F.split("text", "\n")).alias("title")).where("title <> ''")
    return lines.groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("select opp_id, stage, created_on from ghl_opportunities where opp_id is not null")
def s9_json_lines(t: Tables):
    # Every record is followed by a line that is none.
    folder = new_folder(t.spark, "lines")
    good = F.to_json(F.struct("opp_id", "stage", "created_on"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    t.ghl_opportunities.where("opp_id is not null").select(F.explode(F.array(good, F.concat(F.lit("{bad "), "opp_id"))).alias("value")).write.text(folder)
    return json_lines(t.spark, folder, "opp_id string, stage string, created_on timestamp_ntz").select("opp_id", "stage", "created_on")


@query(r"""select doc_id, cast((len(text) - len(replace(text, '-->', ''))) / 3 as integer) as cues from documents where position('-->' in text) > 0 and regexp_matches(text, '\d\d:\d\d:\d\d\.\d{3} --> ') and len(regexp_extract_all(text, '(?m)^[^\n]*-->[^\n]*$')) = (len(text) - len(replace(text, '-->', ''))) / 3
 and len(regexp_extract_all(text, '\n[ \t]*\n')) + 1 >= (len(text) - len(replace(text, '-->', ''))) / 3""")
def s10_captions(t: Tables):
    n = F.size(cues(F.col("text")))
    docs = t.documents.where(F.col("text").contains("-->") & F.col("text").rlike(r"\d\d:\d\d:\d\d\.\d{3} --> "))
    arrows = F.regexp_count("text", F.lit("-->"))
    whole = docs.where((F.regexp_count("text", F.lit(r"(?m)^[^\n]*-->[^\n]*$")) == arrows) & (F.regexp_count("text", F.lit(r"\n[ \t]*\n")) + 1 >= arrows))
    return whole.select("doc_id", n.alias("cues"))


@query("select doc_id, title from documents where text is null and doc_id is not null order by doc_id desc limit 25")
def s11_filtered_top(t: Tables):
    return top(t.documents.where("text is null and doc_id is not null").select("doc_id", "title"), 25, F.desc("doc_id"))


@query("select distinct lead_id from meta_leads l where exists (select 1 from pursuit_cards c where c.ad_id = l.ad_id)")
def s12_existence(t: Tables):
    return t.meta_leads.join(t.pursuit_cards.select("ad_id"), "ad_id", "left_semi").select("lead_id").distinct()


def count_since(t: Tables, name: str, at: str, since: str) -> int | None:
    """Rows since a time; None if there is no such table."""
    try:
        return t.__getattr__(name).where(F.col(at) >= F.expr(f"timestamp_ntz'{since}'")).count()
    except AnalysisException:
        return None


@query("""select 'giving_gifts' as source, cast((select count(*) from giving_gifts where received_at >= timestamp '2025-12-01') as bigint) as n union all select 'meta_leads', cast((select count(*) from meta_leads where created_time >= timestamp '2025-12-01') as bigint) union all select 'prayer_wall', cast(null as bigint)""")
def s13_counts_or_null(t: Tables):
    rows = [(n, count_since(t, n, c, "2025-12-01")) for n, c in (("giving_gifts", "received_at"), ("meta_leads", "created_time"), ("prayer_wall", "created_at"))]
    return t.spark.createDataFrame(rows, "source string, n bigint")


@query("""select grain, start, cast(count(*) as bigint) as rows_in, cast(sum(impressions) as bigint) as impressions from (select 'day' grain, day as start, impressions from meta_ad_insights union all select 'week', cast(date_trunc('week', day) as date), impressions from meta_ad_insights
 union all select 'month', cast(date_trunc('month', day) as date), impressions from meta_ad_insights) group by 1, 2""")
def s14_grains(t: Tables):
    # One scan for all grains. Reach and frequency do not add up over days, so no grain but the day has them.
    grain = lambda name, start: F.struct(F.lit(name).alias("grain"), start.alias("start"))
    at = F.explode(F.array(grain("day", F.col("day")), grain("week", F.trunc("day", "week")), grain("month", F.trunc("day", "month"))))
    return t.meta_ad_insights.select(at.alias("g"), "impressions").groupBy("g.grain", "g.start").agg(F.count(F.lit(1)).alias("rows_in"), F.sum("impressions").alias("impressions"))


# Sinks.


_NEWS = """news as (select pco_person_id, r.email, r.phone from (select pco_person_id, max({'u': coalesce(updated_at, timestamp '1900-01-01'), 'email': email, 'phone': phone}) r from pco_people group by 1)),
 old as (select pco_person_id, min(id) id, min(email) email, min(phone) phone from pursuit_people where pco_person_id is not null group by 1)"""


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.pursuit_people.where("pco_person_id is not null").groupBy("pco_person_id").agg(F.min("id").alias("id"), F.min("email").alias("email"), F.min("phone").alias("phone"))
    new = t.pco_people.groupBy("pco_person_id").agg(F.max(F.struct(F.coalesce("updated_at", F.expr("timestamp_ntz'1900-01-01'")), "email", "phone")).alias("r")).select("pco_person_id", "r.email", "r.phone")
    return old, new


@query(f"with {_NEWS} select coalesce(o.pco_person_id, n.pco_person_id) as pco_person_id, o.id, coalesce(n.email, o.email) as email, coalesce(n.phone, o.phone) as phone from old o full join news n on n.pco_person_id = o.pco_person_id")
def k1_upsert(t: Tables):
    # Through a versioned table: written, changed by key, read.
    old, new = _old_new(t)
    people = Mirror(t.spark, new_folder(t.spark, "people"))
    people.write(old)
    return people.upsert(new, ["pco_person_id"], [F.col("email"), F.col("phone")])


@query("select membership_id, group_id from pco_group_memberships where role is not null and lower(role) = 'leader' or group_id in (select group_id from pco_group_memberships group by 1 having max(synced_at) < timestamp '2025-12-01' or max(synced_at) is null)")
def k2_replaced_groups(t: Tables):
    # All groups synced lately now hold their leaders only; a group without leaders goes.
    m = t.pco_group_memberships
    target = m.select("membership_id", "group_id")
    touched = m.groupBy("group_id").agg(F.max("synced_at").alias("s")).where("s >= timestamp_ntz'2025-12-01'")
    source = m.where("lower(role) = 'leader'").select("membership_id", "group_id")
    return replaced_groups(target, source, "group_id", touched)


@query("select doc_id, word from (select doc_id, unnest(string_split(lower(title), ' ')) word from documents where title is not null)")
def k3_children(t: Tables):
    words = t.documents.where("title is not null").select("doc_id", F.explode(F.split(F.lower("title"), " ")).alias("word"))
    kept = Mirror(t.spark, new_folder(t.spark, "words"))
    kept.write(words.where("doc_id % 2 = 0"))
    return kept.append(words.where("doc_id % 2 = 1"))


@query(f"with r as (select pco_person_id k, max(name) nm, max(email) em from pco_people group by 1) select gift_id, created_at, coalesce(donor_name, r.nm) as donor_name, coalesce(donor_email, r.em) as donor_email from giving_gifts g left join r on r.k = {plain_sql('g.pco_person_id')}")
def k4_update_by_predicate(t: Tables):
    names = t.pco_people.groupBy(F.col("pco_person_id").alias("giver")).agg(F.max("name").alias("nm"), F.max("email").alias("em"))
    return gifts(t).join(names, "giver", "left").select("gift_id", "created_at", F.coalesce("donor_name", "nm").alias("donor_name"), F.coalesce("donor_email", "em").alias("donor_email"))


@query("with seeds as (select distinct source from documents where source is not null) select source, coalesce(target_share, 0.0) as share, target_share is null as seeded from (select source, target_share from mix_targets union all select source, null from seeds where source not in (select source from mix_targets))")
def k5_seed_and_update(t: Tables):
    target = t.mix_targets.select("source", "target_share")
    seeds = t.documents.where("source is not null").select("source", F.lit(None).cast("double").alias("target_share"))
    rows = inserted_missing(target, seeds, ["source"], [F.col("source")])
    return rows.select("source", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.col("target_share").isNull().alias("seeded"))


@query("select gift_id, arg_min(amount_cents, (coalesce(created_at, timestamp '1900-01-01'), amount_cents)) as amount_cents from giving_gifts where gift_id is not null group by 1")
def k6_incremental_load(t: Tables):
    # The first load up to a time; the second takes what was written later and is not known yet.
    rows = t.giving_gifts.where("gift_id is not null").select("gift_id", F.coalesce("created_at", F.expr("timestamp_ntz'1900-01-01'")).alias("written"), "amount_cents")
    mark = F.expr("timestamp_ntz'2025-01-01'")
    first = inserted_missing(rows.limit(0), rows.where(F.col("written") <= mark), ["gift_id"], [F.col("written"), F.col("amount_cents")])
    kept = Mirror(t.spark, new_folder(t.spark, "gifts"))
    kept.write(first)
    return kept.insert_missing(rows.where(F.col("written") > mark), ["gift_id"], [F.col("written"), F.col("amount_cents")]).select("gift_id", "amount_cents")


@query("select '| ' || campaign_id || ' | ' || format('{:,}', cast(sum(impressions) as bigint)) || ' | ' || cast(round(100.0 * sum(clicks) / sum(impressions), 1) as decimal(10, 1)) || '% |' as line from meta_ad_insights group by campaign_id having sum(impressions) > 0")
def k7_report_lines(t: Tables):
    by = t.meta_ad_insights.groupBy("campaign_id").agg(F.sum("impressions").alias("i"), F.sum("clicks").alias("c")).where("i > 0")
    return by.select(F.concat(F.lit("| "), "campaign_id", F.lit(" | "), F.format_number("i", 0), F.lit(" | "), F.round(F.col("c") * 100.0 / F.col("i"), 1).cast("decimal(10,1)").cast("string"), F.lit("% |")).alias("line"))


@query("select cast(count(distinct lead_id) as bigint) as fresh from meta_leads where created_time >= timestamp '2025-12-01' and lead_id not in (select lead_id from meta_leads where created_time < timestamp '2025-12-01' and lead_id is not null)")
def k8_fresh_count(t: Tables):
    recent = t.meta_leads.where("created_time >= timestamp_ntz'2025-12-01'")
    return recent.join(t.meta_leads.where("created_time < timestamp_ntz'2025-12-01'").select("lead_id"), "lead_id", "left_anti").agg(F.count_distinct("lead_id").alias("fresh"))


@query(f"with {_NEWS} select case when o.pco_person_id is null then 'insert' when (n.email is not null and n.email is distinct from o.email) or (n.phone is not null and n.phone is distinct from o.phone) then 'update' else 'same' end as kind, cast(count(*) as bigint) as n from news n left join old o on o.pco_person_id = n.pco_person_id group by 1")
def k10_dry_run(t: Tables):
    old, new = _old_new(t)
    return preview(old, new, ["pco_person_id"], ["email", "phone"])


# Streams and what stands for them.


@query("select gift_id, max({'c': created_at, 'a': amount_cents, 'f': fund}).a as amount_cents from giving_gifts where gift_id is not null and created_at is not null group by 1")
def m1_keyed_stream(t: Tables):
    stream = file_stream(t.spark, f"{t.folder}/giving_gifts.parquet")
    return keep_newest(stream, new_folder(t.spark, "stream"), ["gift_id"], "created_at", ["amount_cents", "fund"]).select("gift_id", "amount_cents")


@query("""with v as (select ad_id, day, max({'c': created_at, 's': spend}) r from meta_ad_insights where ad_id is not null and day is not null and (created_at is null or created_at < cast(day as timestamp) + interval 29 day) group by 1, 2) select ad_id, day, cast(r.s as double) as spend from v""")
def m2_late_revisions(t: Tables):
    # A day may be revised for 28 days; what comes later no longer counts.
    intime = F.col("created_at").isNull() | (F.col("created_at") < F.col("day").cast("timestamp_ntz") + F.expr("interval 29 day"))
    return latest_version(t.meta_ad_insights.where(intime), ["ad_id", "day"], "created_at", ["spend"]).select("ad_id", "day", F.col("spend").cast("double").alias("spend"))


@query("select cast(count(*) as bigint) as n, max(created_at) as mark from giving_gifts where created_at > (select max(created_at) from giving_gifts where created_at <= timestamp '2025-06-30')")
def m3_high_water_mark(t: Tables):
    mark = t.giving_gifts.where("created_at <= timestamp_ntz'2025-06-30'").agg(F.max("created_at")).scalar()
    later = t.giving_gifts.where(F.col("created_at") > mark)
    return later.agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("mark"))


@query("select gift_id, created_at - received_at <= interval 14 day as counted from giving_gifts where created_at is not null and received_at is not null")
def m4_lateness(t: Tables):
    return t.giving_gifts.where("created_at is not null and received_at is not null").select("gift_id", (F.col("created_at") <= F.col("received_at") + F.expr("interval 14 day")).alias("counted"))


@query("select pco_person_id from pco_people group by 1 having max(email) is null and max(phone) is null")
def m5_heal_later(t: Tables):
    # Incomplete now, to be tried again at the next run.
    return t.pco_people.groupBy("pco_person_id").agg(F.max("email").alias("e"), F.max("phone").alias("p")).where("e is null and p is null").select("pco_person_id")


_WINDOWS = (7, 14, 28, 30, 90, 180, 730)


@query(f"select {_GIVER} as giver, " + ", ".join(f"cast(count(*) filter (where received_at > timestamp '2026-01-01' - interval {n} day) as bigint) as last_{n}" for n in _WINDOWS) + f" from giving_gifts where {_GIVER} is not null group by 1")
def m6_trailing_windows(t: Tables):
    return gifts(t).where("giver is not null").groupBy("giver").agg(*[F.count_if(F.col("received_at") > F.expr(f"{NOW_AT} - interval {n} day")).alias(f"last_{n}") for n in _WINDOWS])


@query("select cast(time_bucket(interval 7 day, ts, timestamp '1970-01-01') as timestamp) as start, event_type, cast(count(*) as bigint) as n from events group by 1, 2")
def m6_tumbling_windows(t: Tables):
    w = F.window("ts", "7 days")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_CLOCK = "case when seen is null or timestamp '2026-01-01' - seen > interval 730 day then 'inactive' when timestamp '2026-01-01' - seen > interval 180 day then 'dormant' else 'active' end"


@query(f"select person, {_CLOCK} as state from (select p person, max(seen) seen from ({_SIGNALS}) where p is not null and seen is not null group by 1)")
def m7_clock(t: Tables):
    return last_signal(t).select("person", clock_state(F.col("at"), F.expr(NOW_AT)).alias("state"))


@query(f"select giver, {_CLOCK} as state from (select {_GIVER} giver, max(received_at) seen from giving_gifts where {_GIVER} is not null and received_at is not null group by 1)")
def m7_clock_stream(t: Tables):
    stream = file_stream(t.spark, f"{t.folder}/giving_gifts.parquet").select(plain_id(F.col("pco_person_id")).alias("giver"), "received_at")
    seen = last_seen(stream, new_folder(t.spark, "clock"), "giver", "received_at")
    return seen.select("giver", clock_state(F.col("received_at"), F.expr(NOW_AT)).alias("state"))
