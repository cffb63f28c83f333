"""Scalar functions and row-wise operators, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested, text, times
from .book import NOW, Book, Tables

book = Book()
query = book.query
NOW_AT = f"timestamp_ntz'{NOW}'"
_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def strip(c: str) -> str:
    return _STRIP.replace("{c}", c)


# Stages of the funnel by how they are spelled, and orders of preference.
STAGES = {"new": "new", "planned visit": "planned", "planned_visit": "planned", "confirmed": "confirmed", "attended": "attended", "no show": "missed", "not coming": "missed"}
TIERS = ("friendship", "fellowship", "discipleship", "partnership", "leadership")
RESULTS = ("onsite_conversion.lead_grouped", "lead", "link_click")


@query(f"""select lead_id, case when position('@' in v) > 0 and position('.' in split_part(v, '@', -1)) > 0 then v end as email
 from (select lead_id, lower({strip('email')}) v from meta_leads)""")
def x1_norm_email(t: Tables):
    return t.meta_leads.select("lead_id", text.norm_email(F.col("email")).alias("email"))


@query("""select lead_id, case when length(v) >= 10 then right(v, 10) end as phone from (select lead_id, regexp_replace(phone, '[^0-9]', '', 'g') v from meta_leads)""")
def x2_norm_phone(t: Tables):
    return t.meta_leads.select("lead_id", text.norm_phone(F.col("phone")).alias("phone"))


@query(f"""select pco_person_id, nullif(w[1], '') as given, nullif(array_to_string(w[2:], ' '), '') as rest from (select pco_person_id, string_split_regex({strip('name')}, '\\s+') w from pco_people)""")
def x3_split_name(t: Tables):
    return t.pco_people.select("pco_person_id", text.first_word(F.col("name")).alias("given"), text.other_words(F.col("name")).alias("rest"))


@query("""select opp_id, case when stage is not null then date_trunc('second', created_on) end as at from ghl_opportunities""")
def x4_lenient_time(t: Tables):
    # As an interface would send it: with Z, or a word where there is no stage.
    sent = F.when(F.col("stage").isNotNull(), F.date_format("created_on", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("n/a")
    return t.ghl_opportunities.select("opp_id", text_time(sent).alias("at"))


def text_time(c):
    return times.lenient_time(c)


@query("""select doc_id, case when doc_id % 3 < 2 then preached_date end as day from documents""")
def x5_any_date(t: Tables):
    d = F.col("preached_date")
    sent = F.when(F.col("doc_id") % 3 == 0, F.date_format(d, "yyyy-M-d")).when(F.col("doc_id") % 3 == 1, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "MMM d yyyy"))
    return t.documents.select("doc_id", times.any_date(sent).alias("day"))


@query(r"""select doc_id, clock, case len(p) when 3 then p[1]*3600 + p[2]*60 + p[3] when 2 then p[1]*60 + p[2] end as seconds
 from (select doc_id, clock, list_transform(string_split(clock, ':'), lambda x: try_cast(x as integer)) p from (select doc_id, regexp_extract(text, '\d+:\d{2}(:\d{2})?') clock from documents where text is not null))""")
def x6_clock_seconds(t: Tables):
    clock = F.regexp_extract("text", r"\d+:\d{2}(:\d{2})?", 0)
    return t.documents.where("text is not null").select("doc_id", clock.alias("clock"), times.clock_seconds(clock).alias("seconds"))


@query("""select card_id, strftime(planned_for, '%Y-%m-%d') as day from pursuit_cards where planned_for is not null""")
def x7_compact_date(t: Tables):
    return t.pursuit_cards.where("planned_for is not null").select("card_id", times.compact_date(F.date_format("planned_for", "yyyyMMdd")).alias("day"))


@query(r"""select doc_id, nullif(regexp_extract(url, '[?&]v=([\w-]+)', 1), '') as video from documents""")
def x8_url_param(t: Tables):
    return t.documents.select("doc_id", text.url_param(F.col("url"), "v").alias("video"))


@query("""select doc_id, title, speaker, coalesce(cast(preached_date as varchar), '') as preached from documents where title is not null and speaker is not null""")
def x9_header_block(t: Tables):
    # A transcript as it is filed, header and all; reading it gives back what went in. The first title is overruled.
    rule, line = F.lit("=" * 20), F.lit("\n")
    filed = F.concat(rule, line, F.lit("Title: draft"), line, F.lit("TITLE : "), F.col("title"), line, F.lit("Speaker: "), F.col("speaker"), line, F.lit("Preached: "), F.coalesce(F.col("preached_date").cast("string"), F.lit("")), line, rule, line, F.coalesce("text", F.lit("")))
    head = t.documents.where("title is not null and speaker is not null").select("doc_id", text.header_block(filed).alias("h"))
    return head.select("doc_id", F.col("h")["title"].alias("title"), F.col("h")["speaker"].alias("speaker"), F.col("h")["preached"].alias("preached"))


_FOLD = """list_reduce(list_transform({lines}, lambda x: [x]), lambda acc, x: case when len(acc) > 0 and ends_with(acc[-1], x[1]) then acc else list_concat(acc, x) end, cast([] as varchar[]))"""


@query(r"""select doc_id, len(kept) as lines, array_to_string(kept, ' ') as spoken from (select doc_id, """ + _FOLD.replace("{lines}", "lines") + r""" kept from (
 select doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\[(?i:music|applause|laughter)\]', '', 'g'), '^\s+|\s+$', '', 'g')),
  lambda x: x <> '' and position('-->' in x) = 0 and not regexp_matches(x, '^(WEBVTT|Kind:|Language:|NOTE|\d+$)')) lines from documents where text is not null))""")
def x10_caption_lines(t: Tables):
    kept = t.documents.where("text is not null").select("doc_id", text.caption_lines(F.col("text")).alias("kept"))
    return kept.select("doc_id", F.size("kept").cast("bigint").alias("lines"), F.array_join("kept", " ").alias("spoken"))


@query(r"""select doc_id, array_to_string(list_transform(regexp_extract_all(lower(speaker), '(\pL+|\PL+)'), lambda w: upper(w[1]) || w[2:]), '') as speaker from documents""")
def x11_title_case(t: Tables):
    return t.documents.select("doc_id", text.title_case(F.upper("speaker")).alias("speaker"))


@query("""select ad_id, day, action_type, cast(coalesce(trunc(try_cast(nullif(v, '') as double)), 0) as bigint) as n from (select ad_id, day, unnest(actions).action_type action_type, unnest(actions).value v from meta_ad_insights)""")
def x12_numbers_in_text(t: Tables):
    return t.meta_ad_insights.select("ad_id", "day", F.explode("actions").alias("a")).select("ad_id", "day", "a.action_type", nested.whole(F.col("a.value")).alias("n"))


@query("""select ad_id, day, coalesce(round(100.0 * cast(clicks as double) / nullif(impressions, 0), 6), 0) as ctr, round(cast(spend as double) / nullif(results, 0), 6) as cost from meta_ad_insights""")
def x13_rates(t: Tables):
    return t.meta_ad_insights.select("ad_id", "day", F.round(nested.rate(F.col("clicks"), F.col("impressions")), 6).alias("ctr"), F.round(nested.cost(F.col("spend"), F.col("results")), 6).alias("cost"))


@query("""with long as (select rn, unnest(actions) a, generate_subscripts(actions, 1) i from (select row_number() over () rn, actions from meta_ad_insights)),
 last as (select rn, a.action_type k, arg_max(cast(coalesce(trunc(try_cast(nullif(a.value, '') as double)), 0) as bigint), i) n from long where a.action_type is not null group by 1, 2),
 best as (select rn, arg_min(k, r) kind, arg_min(n, r) n from (select *, case k when 'onsite_conversion.lead_grouped' then 1 when 'lead' then 2 when 'link_click' then 3 end r from last where n <> 0) where r is not null group by 1)
 select kind, cast(count(*) as bigint) as rows_with, cast(sum(n) as bigint) as n from best group by 1""")
def x14_first_priced_action(t: Tables):
    best = t.meta_ad_insights.select(nested.first_priced(F.col("actions"), RESULTS).alias("b")).where("b is not null")
    return best.groupBy("b.kind").agg(F.count(F.lit(1)).alias("rows_with"), F.sum("b.n").alias("n"))


@query("""with long as (select lead_id, created_at, full_name, email, phone, unnest(field_data) f, generate_subscripts(field_data, 1) i from meta_leads),
 last as (select lead_id, lower(f.name) k, arg_max(f.values[1], i) v from long where f.name is not null and f.values[1] is not null group by lead_id, lower(f.name))
 select lead_id, k as field, v as answer from last""")
def x15_answers(t: Tables):
    items = F.transform("field_data", lambda f: F.struct(F.lower(f["name"]).alias("name"), F.get(f["values"], F.lit(0)).alias("value")))
    known = F.filter(items, lambda f: f["value"].isNotNull())
    rows = t.meta_leads.select("lead_id", F.explode(nested.by_name(known, "name", "value")).alias("field", "answer"))
    return rows.groupBy("lead_id", "field").agg(F.max("answer").alias("answer"))


@query("""select substr(cast(day as varchar), 1, 7) as month, cast(count(*) as bigint) as n from meta_ad_insights group by 1""")
def x16_month_by_prefix(t: Tables):
    return t.meta_ad_insights.groupBy(F.left(F.col("day").cast("string"), F.lit(7)).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""select cast(date_trunc('month', received_at) as date) as month, strftime(received_at, '%Y-%m') as label, cast(count(*) as bigint) as n from giving_gifts group by 1, 2""")
def x17_month_start(t: Tables):
    at = F.col("received_at")
    return t.giving_gifts.groupBy(times.month_start(at).alias("month"), times.month_text(at).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""select distinct planned_for, cast(date_trunc('month', planned_for) - interval 23 month as date) as two_years from pursuit_cards where planned_for is not null""")
def x18_months_back(t: Tables):
    return t.pursuit_cards.where("planned_for is not null").select("planned_for", times.months_back(F.col("planned_for"), 23).alias("two_years")).distinct()


@query(f"""select id, round(cast(epoch_us(timestamp '{NOW}') - epoch_us(first_seen_at) as double) / 2629800000000, 1) as months, cast(coalesce(floor((epoch_us(timestamp '{NOW}') - epoch_us(last_signal_at)) / 86400000000.0), -1) as integer) as quiet from pursuit_people""")
def x19_ages(t: Tables):
    return t.pursuit_people.select("id", times.age_months(F.col("first_seen_at"), F.expr(NOW_AT)).alias("months"), times.days_since(F.col("last_signal_at"), F.expr(NOW_AT)).alias("quiet"))


@query("""select card_id, cast(floor((epoch_us(cast(planned_for as timestamp)) - epoch_us(created_at)) / 86400000000.0) as integer) as ahead from pursuit_cards where planned_for is not null and created_at is not null""")
def x20_whole_days(t: Tables):
    return t.pursuit_cards.where("planned_for is not null and created_at is not null").select("card_id", times.days_since(F.col("created_at"), F.col("planned_for").cast("timestamp_ntz")).alias("ahead"))


@query("""select lead_id, cast((created_time at time zone 'UTC') at time zone 'America/Chicago' as date) as day, cast(isodow((created_time at time zone 'UTC') at time zone 'America/Chicago') - 1 as integer) as weekday from meta_leads""")
def x21_local_day(t: Tables):
    day = times.local_day(F.col("created_time"), "America/Chicago")
    return t.meta_leads.select("lead_id", day.alias("day"), F.weekday(day).alias("weekday"))


@query("""select pco_person_id, bool_or(coalesce(lower(role) = 'leader', false)) as leads from pco_group_memberships where pco_person_id is not null group by 1""")
def x22_list_holds(t: Tables):
    roles = t.pco_group_memberships.where("pco_person_id is not null").groupBy("pco_person_id").agg(F.collect_set(F.lower("role")).alias("roles"))
    return roles.select("pco_person_id", nested.holds(F.col("roles"), F.lit("leader")).alias("leads"))


@query(r"""select doc_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as title,
 case when n_chars = 1 then '1 sign' else n_chars || ' signs' end as size from documents""")
def x25_escaped_and_counted(t: Tables):
    return t.documents.select("doc_id", text.html_escaped(F.col("title")).alias("title"), text.counted(F.col("n_chars"), "sign").alias("size"))


@query("""select doc_id, left(title, 12) as head, right(title, 6) as tail from documents""")
def x26_cut(t: Tables):
    return t.documents.select("doc_id", F.left("title", F.lit(12)).alias("head"), F.right("title", F.lit(6)).alias("tail"))


@query("""select fund, '{"fund":"' || fund || '","gifts":' || count(*) || ',"givers":' || count(distinct pco_person_id) || '}' as doc from giving_gifts where fund is not null group by fund""")
def x27_json_object(t: Tables):
    by = t.giving_gifts.where("fund is not null").groupBy("fund").agg(F.count(F.lit(1)).alias("gifts"), F.count_distinct("pco_person_id").alias("givers"))
    return by.select("fund", F.to_json(F.struct("fund", "gifts", "givers")).alias("doc"))


def clamped(value: str | None, default: int, low: int, high: int) -> int:
    """A whole number from a setting; the default if it is missing or unreadable, held within its limits."""
    try:
        n = int(value) if value not in (None, "") else default
    except ValueError:
        n = default
    return max(low, min(high, n))


@query("""select cast(count(*) as bigint) as gifts from giving_gifts where received_at >= timestamp '2026-01-01' - interval 365 day""")
def x28_clamped_setting(t: Tables):
    days = clamped("4000", 30, 1, 365)
    return t.giving_gifts.where(F.col("received_at") >= F.expr(NOW_AT) - F.expr(f"interval {days} day")).agg(F.count(F.lit(1)).alias("gifts"))


@query("""select case when strftime(day, '%Y-%m') < '2025-01' then 'before' else 'after' end as era, cast(count(*) as bigint) as n from meta_ad_insights group by 1""")
def x29_era(t: Tables):
    return t.meta_ad_insights.groupBy(times.era(times.month_text(F.col("day")), "2025-01").alias("era")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select pco_person_id, coalesce(lower({strip('membership')}) in ('member', 'partner'), false) as belongs from pco_people""")
def x30_classified(t: Tables):
    return t.pco_people.select("pco_person_id", text.is_one_of(F.col("membership"), ("member", "partner")).alias("belongs"))


@query("""select id, coalesce(nullif(email, ''), 'none') as email, cast(coalesce(deceased, false) as integer) + cast(pinned_by is not null as integer) as flags from pursuit_people""")
def x31_null_idioms(t: Tables):
    return t.pursuit_people.select("id", F.coalesce(F.nullif("email", F.lit("")), F.lit("none")).alias("email"), (F.coalesce("deceased", F.lit(False)).cast("int") + F.col("pinned_by").isNotNull().cast("int")).alias("flags"))


# Row-wise operators.


@query("""select lead_id, u.k as part, u.v as value from (select lead_id, unnest([{'k': 'who.name', 'v': full_name}, {'k': 'who.email', 'v': email}, {'k': 'ad.campaign', 'v': campaign_id}]) u from meta_leads)""")
def row1_flattened(t: Tables):
    deep = t.meta_leads.select("lead_id", F.struct(F.col("full_name").alias("name"), "email").alias("who"), F.struct(F.col("campaign_id").alias("campaign")).alias("ad"))
    flat = deep.select("lead_id", "who.name", "who.email", "ad.campaign")
    return flat.unpivot("lead_id", ["name", "email", "campaign"], "part", "value").replace({"name": "who.name", "email": "who.email", "campaign": "ad.campaign"}, subset=["part"])


@query("""select lead_id, case when ad_id is not null then campaign_id end as campaign from meta_leads""")
def row2_deep_path(t: Tables):
    # The inner record is missing where there is no ad: the path through it is NULL, not an error.
    inner = F.when(F.col("ad_id").isNotNull(), F.struct(F.struct("campaign_id").alias("campaign")))
    return t.meta_leads.select("lead_id", inner.alias("ad")).select("lead_id", F.col("ad.campaign.campaign_id").alias("campaign"))


@query("""select pco_person_id, coalesce(nullif(name, ''), nullif(trim(concat_ws(' ', nullif(first_name, ''), nullif(last_name, ''))), ''), nullif(email, ''), 'unknown') as shown from pco_people""")
def row3_first_filled(t: Tables):
    both = F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit("")))
    return t.pco_people.select("pco_person_id", F.coalesce(text.filled(F.col("name"), F.trim(both), F.col("email")), F.lit("unknown")).alias("shown"))


@query("""select coalesce(nullif(fund, ''), 'General') as fund, cast(count(*) as bigint) as n from giving_gifts group by 1""")
def row4_default(t: Tables):
    return t.giving_gifts.groupBy(F.coalesce(text.filled(F.col("fund")), F.lit("General")).alias("fund")).agg(F.count(F.lit(1)).alias("n"))


@query("""select p.id, coalesce(r.email, p.email) as email, coalesce(r.phone, p.phone) as phone from pursuit_people p left join (select pco_person_id, max(email) email, max(phone) phone from pco_people group by 1) r on r.pco_person_id = p.pco_person_id""")
def row5_partial_update(t: Tables):
    news = t.pco_people.groupBy("pco_person_id").agg(F.max("email").alias("new_email"), F.max("phone").alias("new_phone"))
    return t.pursuit_people.join(news, "pco_person_id", "left").select("id", F.coalesce("new_email", "email").alias("email"), F.coalesce("new_phone", "phone").alias("phone"))


@query("""select lang, cast(count(*) as bigint) as n from documents where verified group by 1""")
def row6_flag_filter(t: Tables):
    return t.documents.where("verified").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("""select opp_id, stage from ghl_opportunities where email is not null and lower(trim(coalesce(stage, 'new'))) not in ('no show', 'not coming')""")
def row7_negative_list(t: Tables):
    return t.ghl_opportunities.where(F.col("email").isNotNull() & ~F.lower(F.trim(F.coalesce("stage", F.lit("new")))).isin("no show", "not coming")).select("opp_id", "stage")


@query("""select gift_id, (coalesce(fund = 'Missions', false) or coalesce(recurring, false)) as steady from giving_gifts""")
def row8_derived_flag(t: Tables):
    return t.giving_gifts.select("gift_id", (F.coalesce(F.col("fund") == "Missions", F.lit(False)) | F.coalesce("recurring", F.lit(False))).alias("steady"))


@query("""select doc_id from documents where coalesce(verified, true) and (duration_seconds is null or duration_seconds = 0 or duration_seconds >= 1200) and not (contains(lower(coalesce(title, '')), 'table') or contains(lower(coalesce(title, '')), 'salt'))""")
def row9_admitted(t: Tables):
    title, length = F.coalesce("title", F.lit("")), F.coalesce("duration_seconds", F.lit(0))
    return t.documents.where(F.coalesce("verified", F.lit(True)) & ((length == 0) | (length >= 1200)) & text.first_keyword(title, ("table", "salt")).isNull()).select("doc_id")


@query("""select doc_id, case when contains(lower(text), 'grace') then 'grace' when contains(lower(text), 'mercy') then 'mercy' when contains(lower(text), 'table') then 'table' end as word from documents where text is not null""")
def row10_first_keyword(t: Tables):
    return t.documents.where("text is not null").select("doc_id", text.first_keyword(F.col("text"), ("grace", "mercy", "table")).alias("word"))


_STAGE = "case lower(" + strip("stage") + ") " + " ".join(f"when '{k}' then '{v}'" for k, v in STAGES.items()) + " end"


@query(f"""select opp_id, {_STAGE} as stage from ghl_opportunities where {_STAGE} is not null""")
def row11_mapped(t: Tables):
    return t.ghl_opportunities.select("opp_id", text.mapped(F.col("stage"), STAGES).alias("stage")).where("stage is not null")


@query("""select opp_id from ghl_opportunities where lower(coalesce(stage, '')) in ('attended', 'attended ', 'confirmed')""")
def row12_in_list(t: Tables):
    return t.ghl_opportunities.where(F.lower(F.coalesce("stage", F.lit(""))).isin("attended", "attended ", "confirmed")).select("opp_id")


@query("""select group_id, cast(count(*) as bigint) as n from pco_group_memberships where group_name ilike 'charisma%' or group_name ilike 'lantern%' group by 1""")
def row13_prefix(t: Tables):
    return t.pco_group_memberships.where(F.ilike("group_name", F.lit("charisma%")) | F.ilike("group_name", F.lit("lantern%"))).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


@query("""select id from pursuit_people where coalesce(deceased, false) = false and state <> 'archived'""")
def row14_living(t: Tables):
    return living(t).select("id")


def living(t: Tables):
    return t.pursuit_people.where(~F.coalesce("deceased", F.lit(False)) & (F.col("state") != "archived"))


@query("""select pco_person_id, case when not (contains(u, 'no_photo') or contains(u, '/initials/')) then u end as avatar from (select pco_person_id, lower(trim(avatar_url)) u from pco_people)""")
def row15_pattern_to_null(t: Tables):
    u = F.lower(F.trim("avatar_url"))
    return t.pco_people.select("pco_person_id", F.when(~(u.contains("no_photo") | u.contains("/initials/")), u).alias("avatar"))


@query("""select card_id from pursuit_cards where planned_for is null or planned_for >= date '2025-12-01'""")
def row16_not_expired(t: Tables):
    return t.pursuit_cards.where("planned_for is null or planned_for >= date '2025-12-01'").select("card_id")


_LADDER = "case when last_signal_at is null then 7 when last_signal_at > timestamp '2026-01-01' - interval 1 month then 1 when last_signal_at > timestamp '2026-01-01' - interval 3 month then 2 when last_signal_at > timestamp '2026-01-01' - interval 6 month then 3 when last_signal_at > timestamp '2026-01-01' - interval 12 month then 4 when last_signal_at > timestamp '2026-01-01' - interval 24 month then 5 else 6 end"


def recency_step(c):
    """1 to 6 by calendar months since, 7 for never; a boundary belongs to the older step."""
    steps = F.when(c.isNull(), 7)
    for k, months in enumerate((1, 3, 6, 12, 24), 1):
        steps = steps.when(c > F.expr(NOW_AT) - F.expr(f"interval {months} month"), k)
    return steps.otherwise(6)


@query(f"""select step, cast(count(*) as bigint) as n from (select {_LADDER} step from pursuit_people) group by 1""")
def row17_ladder(t: Tables):
    return t.pursuit_people.groupBy(recency_step(F.col("last_signal_at")).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query("""select id, cast(case tier when 'fellowship' then 1 when 'discipleship' then 2 when 'partnership' then 3 when 'leadership' then 4 else 0 end as integer) as rank from pursuit_people""")
def row18_ranked(t: Tables):
    return t.pursuit_people.select("id", text.ranked(F.col("tier"), TIERS).alias("rank"))


@query("""select lead_id from meta_leads where ad_id is null and email is not null""")
def row19_null_predicates(t: Tables):
    return t.meta_leads.where("ad_id is null and email is not null").select("lead_id")
