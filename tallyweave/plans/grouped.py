"""Aggregates, ordered analysis and top lists over the tables of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nested, text, times
from ..functions.ids import plain_id
from ..operators.relations import arg_by_sum, divided, first_of_each, top, with_share
from .book import Book, Tables
from .general import plain_sql
from .joined import _FLAGS, flagged
from .scalars import NOW_AT

book = Book()
query = book.query
_GIVER = plain_sql("pco_person_id")


def money(c) -> F.Column:
    return c.cast("double")


def gifts(t: Tables) -> DataFrame:
    return t.giving_gifts.withColumn("giver", plain_id(F.col("pco_person_id")))


@query("select fund, cast(count(*) as bigint) as n from giving_gifts group by 1")
def a1_count_per_key(t: Tables):
    return t.giving_gifts.groupBy("fund").agg(F.count(F.lit(1)).alias("n"))


@query("""select campaign_id, min(campaign_name) as name, cast(sum(impressions) as bigint) as impressions, cast(sum(clicks) as bigint) as clicks, cast(sum(spend) as double) as spend, cast(sum(results) as bigint) as results from meta_ad_insights group by 1""")
def a2_rollup(t: Tables):
    return t.meta_ad_insights.groupBy("campaign_id").agg(F.min("campaign_name").alias("name"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), money(F.sum("spend")).alias("spend"), F.sum("results").alias("results"))


@query("""with s as (select campaign_id, result_type, sum(results) w from meta_ad_insights where result_type is not null group by 1, 2) select campaign_id, arg_min(result_type, (-w, result_type)) as result_type, cast(max(w) as bigint) as weight from s group by 1""")
def a3_category_by_weight(t: Tables):
    return arg_by_sum(t.meta_ad_insights, ["campaign_id"], "result_type", "results")


@query("""select cast(coalesce(sum(impressions), 0) as bigint) as impressions, cast(coalesce(sum(spend), 0) as double) as spend, cast(coalesce(sum(results), 0) as bigint) as results from meta_ad_insights""")
def a4_grand_totals(t: Tables):
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return t.meta_ad_insights.agg(z("impressions").alias("impressions"), money(z("spend")).alias("spend"), z("results").alias("results"))


@query("""with m as (select strftime(day, '%Y-%m') as month, coalesce(objective, 'none') o, sum(spend) s from meta_ad_insights group by 1, 2) select month, cast(sum(s) as double) as spend, string_agg(o || '=' || cast(s as varchar), ' ' order by o) as by_objective from m where s is not null group by 1""")
def a5_months_and_objectives(t: Tables):
    by = t.meta_ad_insights.groupBy(times.month_text(F.col("day")).alias("month"), F.coalesce("objective", F.lit("none")).alias("o")).agg(F.sum("spend").cast("decimal(38,2)").alias("s")).where("s is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: F.concat(x["o"], F.lit("="), x["s"].cast("string")))
    return by.groupBy("month").agg(money(F.sum("s")).alias("spend"), F.array_join(parts, " ").alias("by_objective"))


@query("""select campaign_id, strftime(min(day), '%Y-%m') as first_month, strftime(max(day), '%Y-%m') as last_month, arg_min(objective, (day, ad_id)) as objective from meta_ad_insights where objective is not null group by 1""")
def a6_active_range(t: Tables):
    return t.meta_ad_insights.where("objective is not null").groupBy("campaign_id").agg(times.month_text(F.min("day")).alias("first_month"), times.month_text(F.max("day")).alias("last_month"), F.min_by("objective", F.struct("day", "ad_id", "objective")).alias("objective"))


@query("""select case when strftime(day, '%Y-%m') < '2025-01' then 'before' else 'after' end as era, cast(count(distinct strftime(day, '%Y-%m')) as bigint) as months, round(cast(sum(spend) as double) / count(distinct strftime(day, '%Y-%m')), 4) as spend_a_month,
 round(cast(sum(spend) as double) / nullif(sum(results), 0), 4) as cost from meta_ad_insights group by 1""")
def a7_eras(t: Tables):
    month = times.month_text(F.col("day"))
    n = F.count_distinct(month)
    return t.meta_ad_insights.groupBy(times.era(month, "2025-01").alias("era")).agg(n.alias("months"), F.round(money(F.sum("spend")) / n, 4).alias("spend_a_month"), F.round(nested.cost(F.sum("spend"), F.sum("results")), 4).alias("cost"))


@query("""select objective, round(cast(s as double) / cast(sum(s) over () as double), 8) as share from (select coalesce(objective, 'none') objective, coalesce(sum(spend), 0) s from meta_ad_insights group by 1)""")
def a8_share_of_total(t: Tables):
    by = t.meta_ad_insights.groupBy(F.coalesce("objective", F.lit("none")).alias("objective")).agg(F.coalesce(F.sum("spend"), F.lit(0)).alias("s"))
    return with_share(by, "s").select("objective", F.round("share", 8).alias("share"))


@query("""with a as (select campaign_id, ad_id, 100.0 * sum(clicks) / sum(impressions) ctr from meta_ad_insights group by 1, 2 having sum(impressions) >= 1000) select campaign_id, cast(count(*) as bigint) as ads, case when count(*) >= 3 then round(cast(median(cast(ctr as double)) as double), 6) end as mid from a group by 1""")
def a9_guarded_median(t: Tables):
    ads = t.meta_ad_insights.groupBy("campaign_id", "ad_id").agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i")).where("i >= 1000")
    return ads.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("ads"), F.when(F.count(F.lit(1)) >= 3, F.round(F.median(nested.rate(F.col("c"), F.col("i"))), 6)).alias("mid"))


@query("""select tier, cast(count(*) filter (where state = 'active') as bigint) as active, cast(count(*) filter (where state = 'dormant') as bigint) as dormant, cast(count(*) filter (where pinned_by is not null) as bigint) as pinned from pursuit_people group by 1""")
def a10_filtered_counts(t: Tables):
    return t.pursuit_people.groupBy("tier").agg(F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "dormant").alias("dormant"), F.count_if(F.col("pinned_by").isNotNull()).alias("pinned"))


@query(f"select fund, cast(count(distinct {_GIVER}) as bigint) as givers from giving_gifts group by 1")
def a11_count_distinct(t: Tables):
    return gifts(t).groupBy("fund").agg(F.count_distinct("giver").alias("givers"))


@query(f"select {_GIVER} as giver, cast(count(distinct cast(received_at as date)) as bigint) as days from giving_gifts where {_GIVER} is not null group by 1 having count(distinct cast(received_at as date)) >= 10")
def a12_having_distinct(t: Tables):
    return gifts(t).where("giver is not null").groupBy("giver").agg(F.count_distinct(F.to_date("received_at")).alias("days")).where("days >= 10")


@query("""select strftime(received_at, '%Y-%m') as month, cast(coalesce(sum(amount_cents) filter (where fund = 'Missions'), 0) as bigint) as missions, cast(coalesce(sum(amount_cents) filter (where recurring), 0) as bigint) as steady from giving_gifts group by 1""")
def a13_conditional_sums(t: Tables):
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("amount_cents"))), F.lit(0))
    return t.giving_gifts.groupBy(times.month_text(F.col("received_at")).alias("month")).agg(part(F.col("fund") == "Missions").alias("missions"), part(F.col("recurring")).alias("steady"))


@query(f"""select {_GIVER} as giver, cast(count(*) filter (where received_at >= timestamp '2026-01-01' - interval 365 day) as bigint) as recent, arg_max(amount_cents, (received_at, gift_id, created_at, amount_cents)) as last_cents, max(received_at) as last_at from giving_gifts where {_GIVER} is not null and received_at is not null group by 1""")
def a14_gift_window(t: Tables):
    rows = gifts(t).where("giver is not null and received_at is not null")
    return rows.groupBy("giver").agg(F.count_if(F.col("received_at") >= F.expr(f"{NOW_AT} - interval 365 day")).alias("recent"), F.max_by("amount_cents", F.struct("received_at", "gift_id", "created_at", "amount_cents")).alias("last_cents"), F.max("received_at").alias("last_at"))


_SIGNALS = f"""select {_GIVER} p, received_at seen, 1 seq, 'gift' source from giving_gifts union all select {_GIVER}, joined_at, 2, 'group' from pco_group_memberships union all select {_GIVER}, last_signal_at, 3, last_signal_source from pursuit_people"""


def signals(t: Tables) -> DataFrame:
    """When and where each person id was last heard of, from three sources in their order."""
    one = lambda df, at, seq, source: df.select(plain_id(F.col("pco_person_id")).alias("person"), F.col(at).alias("at"), F.lit(seq).alias("seq"), source.alias("source"))
    return one(t.giving_gifts, "received_at", 1, F.lit("gift")).unionByName(one(t.pco_group_memberships, "joined_at", 2, F.lit("group"))).unionByName(one(t.pursuit_people, "last_signal_at", 3, F.col("last_signal_source"))).where("person is not null and at is not null")


def last_signal(t: Tables) -> DataFrame:
    return signals(t).groupBy("person").agg(F.max("at").alias("at"), F.max_by(F.coalesce("source", F.lit("unknown")), F.struct("at", -F.col("seq"), F.coalesce("source", F.lit("unknown")))).alias("source"))


@query(f"select p as person, max(seen) as at, arg_max(coalesce(source, 'unknown'), (seen, -seq, coalesce(source, 'unknown'))) as source from ({_SIGNALS}) where p is not null and seen is not null group by 1".replace(" as at,", ' as "at",'))
def a15_last_signal(t: Tables):
    return last_signal(t)


@query("select user_id, cast(count(distinct cast(ts as date)) as bigint) as days, max(cast(ts as date)) as last_day from events group by 1")
def a16_active_days(t: Tables):
    return t.events.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.max(F.to_date("ts")).alias("last_day"))


_DIVIDED = """with need as (select distinct event_type from events), once as (select user_id, event_type, min(ts) seen from events where ts >= timestamp '2024-01-20' group by 1, 2)
 select user_id, cast(count(*) as bigint) as kinds, max(seen) as done from once join need using (event_type) group by 1 having count(*) = (select count(*) from need)"""


@query(_DIVIDED.replace("cast(count(*) as bigint) as kinds, ", "").replace(", max(seen) as done", ""))
def a17_division(t: Tables):
    return _completed(t).select("user_id")


def _completed(t: Tables) -> DataFrame:
    need = t.events.select(F.lit("all").alias("course"), "event_type").distinct()
    return divided(t.events.where("ts >= timestamp_ntz'2024-01-20'"), need, "user_id", "course", "event_type", "ts")


@query(_DIVIDED.replace("cast(count(*) as bigint) as kinds, ", ""))
def a18_completed_at(t: Tables):
    return _completed(t).select("user_id", F.col("last").alias("done"))


@query(f"select {_GIVER} as giver, min(received_at) as first_at from giving_gifts where {_GIVER} is not null group by 1 having min(received_at) >= timestamp '2025-07-01'")
def a19_first_event(t: Tables):
    return gifts(t).where("giver is not null").groupBy("giver").agg(F.min("received_at").alias("first_at")).where("first_at >= timestamp_ntz'2025-07-01'")


@query(f"select {_GIVER} as giver, arg_min(donor_name, (received_at, gift_id, donor_name)) as name from giving_gifts where {_GIVER} is not null and donor_name is not null and received_at is not null group by 1")
def a20_first_filled_in_group(t: Tables):
    return gifts(t).where("giver is not null and donor_name is not null and received_at is not null").groupBy("giver").agg(F.min_by("donor_name", F.struct("received_at", "gift_id", "donor_name")).alias("name"))


@query(f"select date_trunc('week', received_at)::date as week, cast(sum(amount_cents) as bigint) as cents, cast(count({_GIVER}) as bigint) as with_giver from giving_gifts where received_at is not null group by 1")
def a21_week_totals(t: Tables):
    return gifts(t).where("received_at is not null").groupBy(F.trunc(F.to_date("received_at"), "week").alias("week")).agg(F.sum("amount_cents").alias("cents"), F.count("giver").alias("with_giver"))


@query(f"select coalesce({_GIVER}, nullif(lower(donor_email), '')) as key, cast(count(*) as bigint) as n from giving_gifts where coalesce({_GIVER}, nullif(lower(donor_email), '')) is not null group by 1")
def a22_fallback_key(t: Tables):
    return gifts(t).withColumn("key", F.coalesce("giver", F.nullif(F.lower("donor_email"), F.lit("")))).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("""select campaign_id, arg_min(ad_id, (round(c, 6), ad_id)) as ad_id, round(min(c), 6) as cost from (select campaign_id, ad_id, cast(sum(spend) as double) / sum(results) c from meta_ad_insights group by 1, 2 having sum(results) >= 3 and sum(spend) is not null) group by 1""")
def a23_best_cost(t: Tables):
    ads = t.meta_ad_insights.groupBy("campaign_id", "ad_id").agg(F.sum("spend").alias("s"), F.sum("results").alias("r")).where("r >= 3 and s is not null").withColumn("c", F.round(nested.cost(F.col("s"), F.col("r")), 6))
    return ads.groupBy("campaign_id").agg(F.min_by("ad_id", F.struct("c", "ad_id")).alias("ad_id"), F.min("c").alias("cost"))


@query("select result_type, cast(sum(results) as bigint) as results from meta_ad_insights where result_type is not null group by 1")
def a24_results_by_type(t: Tables):
    return t.meta_ad_insights.where("result_type is not null").groupBy("result_type").agg(F.sum("results").alias("results"))


@query("""select campaign_id, cast(sum(coalesce(list_sum(list_transform(list_filter(actions, lambda a: a.action_type = 'lead'), lambda a: cast(a.value as bigint))), 0)) as bigint) as leads from meta_ad_insights group by 1""")
def a25_sum_in_list(t: Tables):
    return t.meta_ad_insights.groupBy("campaign_id").agg(F.sum(nested.summed(F.col("actions"), "lead")).alias("leads"))


@query(f"select flags, cast(count(*) as bigint) as n from (select cast(gives as integer) + cast(grouped as integer) + cast(lately as integer) flags from ({_FLAGS})) group by 1")
def a26_flag_sums(t: Tables):
    bits = sum((F.col(c).cast("int") for c in ("grouped", "lately")), F.col("gives").cast("int"))
    return flagged(t).groupBy(bits.alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query("""select household_id, '[' || string_agg('{"id":"' || pco_person_id || '","child":' || child || '}', ',' order by pco_person_id) || ']' as members from (select distinct household_id, pco_person_id, child from pco_people where household_id is not null and child is not null) group by 1""")
def a27_ordered_json(t: Tables):
    rows = t.pco_people.where("household_id is not null and child is not null").select("household_id", F.struct(F.col("pco_person_id").alias("id"), "child").alias("m")).distinct()
    return rows.groupBy("household_id").agg(F.to_json(F.array_sort(F.collect_list("m"))).alias("members"))


@query(f"""select '{{"people":' || (select count(*) from pursuit_people) || ',"gifts":' || (select count(*) from giving_gifts) || ',"givers":' || (select count(distinct {_GIVER}) from giving_gifts) || ',"leads":' || (select count(*) from meta_leads) || '}}' as doc""")
def a28_document(t: Tables):
    n = F.count(F.lit(1))
    numbers = {"people": t.pursuit_people.agg(n), "gifts": t.giving_gifts.agg(n), "givers": gifts(t).agg(F.count_distinct("giver")), "leads": t.meta_leads.agg(n)}
    return t.spark.range(1).select(F.to_json(F.struct(*[df.scalar().alias(k) for k, df in numbers.items()])).alias("doc"))


@query("select group_id, array_to_string(list_sort(list_distinct(list(lower(role)) filter (where role is not null))), ',') as roles from pco_group_memberships group by 1")
def a29_sorted_set(t: Tables):
    return t.pco_group_memberships.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower("role"))), ",").alias("roles"))


@query("select stage, cast(count(*) as bigint) as n from pursuit_cards where not archived group by 1")
def a30_kinds(t: Tables):
    return t.pursuit_cards.where("NOT archived").groupBy("stage").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stage")


@query("select series, cast(count(distinct video_id) as bigint) as videos from documents group by 1")
def a31_distinct_size(t: Tables):
    return t.documents.groupBy("series").agg(F.count_distinct("video_id").alias("videos"))


# Ordered analysis.


@query("select person_id, arg_min(card_id, (created_at, card_id)) as card_id from pursuit_cards where created_at is not null group by 1")
def w1_first_per_key(t: Tables):
    return first_of_each(t.pursuit_cards.where("created_at is not null").select("person_id", "card_id", "created_at"), ["person_id"], [F.col("created_at"), F.col("card_id")]).select("person_id", "card_id")


@query("select ad_id, cast(spend as double) as spend from meta_ad_insights where day = (select max(day) from meta_ad_insights)")
def w2_latest_run(t: Tables):
    last = t.meta_ad_insights.agg(F.max("day")).scalar()
    return t.meta_ad_insights.where(F.col("day") == last).select("ad_id", money(F.col("spend")).alias("spend"))


@query(f"select giver, last_at from (select {_GIVER} giver, max(received_at) last_at from giving_gifts where {_GIVER} is not null group by 1 having count(donor_email) = 0 and max(received_at) is not null) order by last_at desc, giver limit 350")
def w3_work_budget(t: Tables):
    # The budget of lookups a run may spend on those that need one, latest first.
    need = gifts(t).where("giver is not null").groupBy("giver").agg(F.max("received_at").alias("last_at"), F.count("donor_email").alias("n")).where("n = 0 and last_at is not null")
    return top(need.select("giver", "last_at"), 350, F.desc("last_at"), F.col("giver"))


@query("""select ad_id, cast(coalesce(sum(clicks) filter (where day between date '2025-12-25' and date '2025-12-31'), 0) as bigint) as week, cast(coalesce(sum(clicks) filter (where day between date '2025-12-18' and date '2025-12-24'), 0) as bigint) as before,
 cast(coalesce(sum(clicks) filter (where day between date '2025-12-04' and date '2025-12-31'), 0) as bigint) as four_weeks from meta_ad_insights group by 1""")
def w4_fixed_windows(t: Tables):
    upto = F.lit("2025-12-31").cast("date")
    part = lambda a, b: F.coalesce(F.sum(F.when(F.col("day").between(F.date_sub(upto, a), F.date_sub(upto, b)), F.col("clicks"))), F.lit(0))
    return t.meta_ad_insights.groupBy("ad_id").agg(part(6, 0).alias("week"), part(13, 7).alias("before"), part(27, 0).alias("four_weeks"))


@query("select series, arg_min(doc_id, (coalesce(preached_date, date '9999-12-31'), doc_id)) as doc_id from documents where series is not null group by 1")
def w5_first_by_order(t: Tables):
    return t.documents.where("series is not null").groupBy("series").agg(F.min_by("doc_id", F.struct(F.coalesce("preached_date", F.lit("9999-12-31").cast("date")), "doc_id")).alias("doc_id"))


@query(r"""select doc_id, cast(len(list_reduce(list_transform(lines, lambda x: [x]), lambda acc, x: case when len(acc) > 0 and ends_with(acc[-1], x[1]) then acc else list_concat(acc, x) end, cast([] as varchar[]))) as integer) as kept
 from (select doc_id, string_split(text, chr(10)) lines from documents where text is not null)""")
def w6_fold_on_last_kept(t: Tables):
    return t.documents.where("text is not null").select("doc_id", F.size(text.folded_lines(F.split("text", "\n"))).alias("kept"))


@query(r"""with s as (select doc_id, list_filter(regexp_split_to_array(replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) +', '\1' || chr(1), 'g'), chr(2), ''), chr(1)), lambda x: x <> '') s from documents where text is not null),
 r as (select doc_id, list_reduce(list_transform(s, lambda x: [1, len(string_split(x, ' '))]), lambda acc, x: case when acc[2] + 1 >= 4 or acc[3] + x[2] >= 120 then [acc[1] + 1, 0, 0] else [acc[1], acc[2] + 1, acc[3] + x[2]] end, [0, 0, 0]) r, len(s) n from s)
 select doc_id, cast(r[1] + case when r[2] > 0 then 1 else 0 end as integer) as chunks, cast(n as integer) as sentences from r""")
def w7_chunks(t: Tables):
    s = text.sentences(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", F.size(text.chunked(s)).alias("chunks"), F.size(s).alias("sentences"))


@query("""select campaign_id, ad_id, round(cast(s as double) / nullif(cast(sum(s) over (partition by campaign_id) as double), 0), 8) as share from (select campaign_id, ad_id, sum(spend) s from meta_ad_insights where spend is not null group by 1, 2)""")
def w9_share_in_group(t: Tables):
    ads = t.meta_ad_insights.where("spend is not null").groupBy("campaign_id", "ad_id").agg(F.sum("spend").alias("s"))
    whole = ads.groupBy("campaign_id").agg(F.sum("s").alias("whole"))
    return ads.join(whole, "campaign_id").select("campaign_id", "ad_id", F.round(F.try_divide(money(F.col("s")), money(F.col("whole"))), 8).alias("share"))


# Top lists.


@query("select campaign_id, leads, spend from (select campaign_id, cast(sum(results) as bigint) leads, cast(coalesce(sum(spend), 0) as double) spend from meta_ad_insights group by 1) order by leads desc, spend desc, campaign_id limit 15")
def t1_top_campaigns(t: Tables):
    by = t.meta_ad_insights.groupBy("campaign_id").agg(F.sum("results").alias("leads"), money(F.coalesce(F.sum("spend"), F.lit(0))).alias("spend"))
    return top(by, 15, F.desc("leads"), F.desc("spend"), F.col("campaign_id"))


@query("select group_id, cast(count(*) as bigint) as n from pco_group_memberships group by 1 order by n desc, group_id limit 8")
def t2_top_groups(t: Tables):
    return top(t.pco_group_memberships.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), 8, F.desc("n"), F.col("group_id"))


@query("select id, cast(floor((epoch_us(timestamp '2026-01-01') - epoch_us(last_signal_at)) / 86400000000.0) as integer) as quiet from pursuit_people where state = 'active' and last_signal_at is not null order by quiet desc, id limit 15")
def t3_quietest(t: Tables):
    quiet = t.pursuit_people.where("state = 'active' and last_signal_at is not null").select("id", times.days_since(F.col("last_signal_at"), F.expr(NOW_AT)).alias("quiet"))
    return top(quiet, 15, F.desc("quiet"), F.col("id"))


@query("select ad_id, day, results from meta_ad_insights order by results desc nulls last, day, ad_id, created_at limit 8")
def t4_first_eight(t: Tables):
    return top(t.meta_ad_insights.select("ad_id", "day", "results", "created_at"), 8, F.desc_nulls_last("results"), F.col("day"), F.col("ad_id"), F.col("created_at")).drop("created_at")


@query("select ad_id, cost from (select ad_id, round(cast(sum(spend) as double) / sum(results), 6) cost from meta_ad_insights group by 1 having sum(results) >= 5 and sum(spend) is not null) order by cost, ad_id limit 1")
def t5_cheapest(t: Tables):
    ads = t.meta_ad_insights.groupBy("ad_id").agg(F.sum("spend").alias("s"), F.sum("results").alias("r")).where("r >= 5 and s is not null")
    return ads.select("ad_id", F.round(nested.cost(F.col("s"), F.col("r")), 6).alias("cost")).agg(F.min(F.struct("cost", "ad_id")).alias("b")).select("b.ad_id", "b.cost")


@query("select membership, cast(count(*) as bigint) as n from pco_people group by 1")
def t6_ordered_counts(t: Tables):
    return t.pco_people.groupBy("membership").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "membership")


@query("select doc_id, preached_date from documents where duration_seconds is null and video_id is not null order by preached_date desc nulls first, doc_id limit 25")
def t7_newest_without(t: Tables):
    return top(t.documents.where("duration_seconds is null and video_id is not null").select("doc_id", "preached_date"), 25, F.desc_nulls_first("preached_date"), F.col("doc_id"))


@query("select user_id, cast(count(*) as bigint) as n from events group by 1 order by n desc, user_id limit 20")
def t9_most_active(t: Tables):
    return top(t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), 20, F.desc("n"), F.col("user_id"))
