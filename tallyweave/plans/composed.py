"""Composed reports over the tables of the domain."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nested, text, times
from ..functions.ids import plain_id
from ..functions.search import STOP_WORDS, search, search_index
from ..operators.components import components
from ..operators.relations import first_of_each, star_pairs, top
from ..operators.rowwise import mapped_rows
from ..operators.rules import fired, verdicts
from ..streaming.flows import clock_state
from .book import Book, Tables
from .general import plain_sql
from .grouped import _SIGNALS, gifts, last_signal, signals
from .joined import _EMAIL, _SERIES, evidence, j11_months_and_series
from .kept import _CLOCK
from .scalars import NOW_AT, TIERS, _LADDER, living, recency_step

book = Book()
query = book.query
_GIVER = plain_sql("pco_person_id")


@query(f"""with r as (select distinct pco_person_id p, lower(regexp_replace(membership, '^\\s+|\\s+$', '', 'g')) m from pco_people),
 g as (select {_GIVER} p, count(*) filter (where received_at >= timestamp '2026-01-01' - interval 730 day) n, max(received_at) seen from giving_gifts where {_GIVER} is not null group by 1)
 select coalesce(m, 'none') as membership, case when coalesce(n, 0) >= 10 then 'often' when n > 0 then 'some' else 'never' end as gives, {_CLOCK} as state, cast(count(*) as bigint) as people from r left join g using (p) group by 1, 2, 3""")
def flagship(t: Tables):
    """The roster by membership, by how often and how lately its people gave: a join, a window per person, a clock, a count."""
    given = gifts(t).where("giver is not null").groupBy(F.col("giver").alias("p")).agg(F.count_if(F.col("received_at") >= F.expr(f"{NOW_AT} - interval 730 day")).alias("n"), F.max("received_at").alias("seen"))
    people = t.pco_people.select(F.col("pco_person_id").alias("p"), F.lower(text.stripped(F.col("membership"))).alias("m")).distinct()
    often = F.when(F.coalesce("n", F.lit(0)) >= 10, "often").when(F.col("n") > 0, "some").otherwise("never")
    return people.join(given, "p", "left").groupBy(F.coalesce("m", F.lit("none")).alias("membership"), often.alias("gives"), clock_state(F.col("seen"), F.expr(NOW_AT)).alias("state")).agg(F.count(F.lit(1)).alias("people"))


@query(r"""with u as (select video_id, 1 tab, doc_id pos, title from documents where video_id is not null and verified union all select video_id, 2, doc_id, title from documents where video_id is not null)
 select video_id, arg_min(title, (tab, pos)) as title from u where title is not null group by 1""")
def row20_first_of_two_inputs(t: Tables):
    side = lambda df, tab: df.where("video_id is not null and title is not null").select("video_id", F.lit(tab).alias("tab"), "doc_id", "title")
    return first_of_each(side(t.documents.where("verified"), 1).unionByName(side(t.documents, 2)), ["video_id"], [F.col("tab"), F.col("doc_id")]).select("video_id", "title")


_STEM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({w}, '^(.{2,})ies$', '\1y'), '^(.*(?:s|x|z|ch|sh))es$', '\1'), '^(.+[^s])s$', '\1'), '^(.{3,})(ing|ed)$', '\1')"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(f"""select doc_id, {_STEM.replace('{w}', 'word')} as word, round(sum(weight), 6) as weight from (select doc_id, unnest(regexp_extract_all(lower(title), '(\\pL+|\\pN+)')) word, 1.0 weight from documents union all select doc_id, unnest(regexp_extract_all(lower(series), '(\\pL+|\\pN+)')), 0.4 from documents) where word not in ({_STOP}) group by 1, 2""")
def x23_search_words(t: Tables):
    return search_index(t.documents, "doc_id", {"title": "A", "series": "B"}).select("doc_id", "word", F.round("weight", 6).alias("weight"))


def _search_sql(limit: str = "") -> str:
    return r"""with d as (select doc_id, lower(coalesce(title, '')) a, lower(coalesce(text, '')) c from documents),
 m as (select doc_id, len(regexp_extract_all(a, '\b(grace|mercy)\b')) na, len(regexp_extract_all(c, '\b(grace|mercy)\b')) nc from d where (regexp_matches(a, '\b(grace|mercy)\b') or regexp_matches(c, '\b(grace|mercy)\b')) and not (regexp_matches(a, '\bcarpenter\b') or regexp_matches(c, '\bcarpenter\b')))
 select doc_id, round(1.0 * ln(1 + na) + 0.2 * ln(1 + nc), 6) as rank from m""" + limit


@query(_search_sql())
def x24_typed_query(t: Tables):
    return search(t.documents, "doc_id", {"title": "A", "text": "C"}, "grace or mercy -carpenter").select("doc_id", F.round("rank", 6).alias("rank"))


@query(_search_sql(" order by rank desc, doc_id limit 10"))
def t8_ranked_search(t: Tables):
    return top(x24_typed_query(t), 10, F.desc("rank"), F.col("doc_id"))


@query()
def w8_shared_key_components(t: Tables):
    """People as components of evidence that shares an id, an e-mail or a phone: component, records, sources."""
    rows = evidence(t).withColumn("rec", F.concat_ws(":", "source", "record")).where("record is not null")
    keys = F.explode(F.array_compact(F.array(*[F.concat(F.lit(c + ":"), F.col(c)) for c in ("pco", "email", "phone")])))
    who = components(rows.select("rec", keys.alias("k")), "rec", "k")
    return rows.select("rec", "source").distinct().join(who, "rec").groupBy("component").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source").alias("sources"))


def ad_weeks(t: Tables) -> DataFrame:
    """Each ad's last seven days beside the seven before: sums, click rate, cost per result. One pass."""
    now = F.col("day").between("2025-12-25", "2025-12-31")
    part = lambda c, when, name: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias(name)
    cols = [part(c, w, f"{c}_{n}") for c in ("impressions", "clicks", "results", "spend") for n, w in (("now", now), ("prior", ~now))]
    return t.meta_ad_insights.where("day between date '2025-12-18' and date '2025-12-31'").groupBy("campaign_id", "ad_id").agg(*cols)


_WEEKS = """w as (select campaign_id, ad_id, """ + ", ".join(f"coalesce(sum({c}) filter (where day {op} date '2025-12-25'), 0) {c}_{n}" for c in ("impressions", "clicks", "results", "spend") for n, op in (("now", ">="), ("prior", "<"))) + """ from meta_ad_insights where day between date '2025-12-18' and date '2025-12-31' group by 1, 2),
 r as (select *, 100.0 * clicks_now / nullif(impressions_now, 0) ctr_now, 100.0 * clicks_prior / nullif(impressions_prior, 0) ctr_prior from w)"""


def ad_rates(t: Tables) -> DataFrame:
    ctr = lambda n: F.try_divide(F.col(f"clicks_{n}") * 100.0, F.col(f"impressions_{n}").cast("double"))
    return ad_weeks(t).withColumns({"ctr_now": ctr("now"), "ctr_prior": ctr("prior")})


@query(f"with {_WEEKS} select ad_id, coalesce(impressions_now >= 100 and ctr_prior > 0 and (ctr_prior - ctr_now) / ctr_prior >= 0.3, false) as flag from r")
def c1a_falling_rate(t: Tables):
    return ad_rates(t).select("ad_id", F.coalesce((F.col("impressions_now") >= 100) & (F.col("ctr_prior") > 0) & (F.try_divide(F.col("ctr_prior") - F.col("ctr_now"), F.col("ctr_prior")) >= 0.3), F.lit(False)).alias("flag"))


@query(f"with {_WEEKS}, m as (select campaign_id, case when count(*) >= 3 then median(ctr_now) end mid from r where impressions_now >= 100 group by 1) select ad_id, coalesce(ctr_now < 0.6 or ctr_now < 0.5 * mid, false) as flag from r left join m using (campaign_id) where impressions_now >= 100")
def c1b_low_rate(t: Tables):
    judged = ad_rates(t).where("impressions_now >= 100")
    mid = judged.groupBy("campaign_id").agg(F.when(F.count(F.lit(1)) >= 3, F.median("ctr_now")).alias("mid"))
    return judged.join(mid, "campaign_id", "left").select("ad_id", F.coalesce((F.col("ctr_now") < 0.6) | F.coalesce(F.col("ctr_now") < 0.5 * F.col("mid"), F.lit(False)), F.lit(False)).alias("flag"))


@query(f"with {_WEEKS} select campaign_id, cast(count(*) as bigint) as judged, case when count(*) >= 3 then round(cast(median(ctr_now) as double), 6) end as mid from r where impressions_now >= 100 group by 1")
def c1c_gated_median(t: Tables):
    return ad_rates(t).where("impressions_now >= 100").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("judged"), F.when(F.count(F.lit(1)) >= 3, F.round(F.median("ctr_now"), 6)).alias("mid"))


@query(f"with {_WEEKS}, c as (select campaign_id, cast(sum(spend_now) as double) / nullif(sum(results_now), 0) avg_cost, sum(spend_now) whole from w group by 1), b as (select campaign_id, arg_min(ad_id, (round(cast(spend_now as double) / results_now, 6), ad_id)) ad_id, min(round(cast(spend_now as double) / results_now, 6)) cost from w where results_now >= 2 group by 1) select campaign_id, ad_id, coalesce(cost <= 0.6 * round(avg_cost, 6), false) as flag from b join c using (campaign_id)")
def c1d_cheap_winner(t: Tables):
    w = ad_weeks(t)
    each = w.where("results_now >= 2").withColumn("cost", F.round(nested.cost(F.col("spend_now"), F.col("results_now")), 6))
    best = each.groupBy("campaign_id").agg(F.min(F.struct("cost", "ad_id")).alias("b")).select("campaign_id", "b.*")
    mean = w.groupBy("campaign_id").agg(F.round(nested.cost(F.sum("spend_now"), F.sum("results_now")), 6).alias("avg_cost"))
    return best.join(mean, "campaign_id").select("campaign_id", "ad_id", F.coalesce(F.col("cost") <= 0.6 * F.col("avg_cost"), F.lit(False)).alias("flag"))


@query(f"with {_WEEKS}, c as (select campaign_id, sum(results_now) rn, sum(results_prior) rp, cast(sum(spend_now) as double) / nullif(sum(results_now), 0) cn, cast(sum(spend_prior) as double) / nullif(sum(results_prior), 0) cp from w group by 1) select campaign_id, coalesce(rn >= 5 and rp >= 5 and cp > 0 and cn >= 1.3 * cp, false) as flag from c")
def c1e_cost_jump(t: Tables):
    by = ad_weeks(t).groupBy("campaign_id").agg(*[F.sum(f"{c}_{n}").alias(f"{c[0]}{n[0]}") for c in ("results", "spend") for n in ("now", "prior")])
    now, prior = nested.cost(F.col("sn"), F.col("rn")), nested.cost(F.col("sp"), F.col("rp"))
    return by.select("campaign_id", F.coalesce((F.col("rn") >= 5) & (F.col("rp") >= 5) & (prior > 0) & (now >= 1.3 * prior), F.lit(False)).alias("flag"))


@query("select id, state = 'dormant' and (dormant_since is null or floor((epoch_us(timestamp '2026-01-01') - epoch_us(dormant_since)) / 86400000000.0) <= 90) as flag from pursuit_people where state is not null")
def c1f_recent_or_unknown(t: Tables):
    days = times.days_since(F.col("dormant_since"), F.expr(NOW_AT))
    return t.pursuit_people.where("state is not null").select("id", ((F.col("state") == "dormant") & (F.col("dormant_since").isNull() | (days <= 90))).alias("flag"))


@query("with a as (select ad_id from meta_ad_insights group by 1), w as (select ad_id, sum(impressions) i from meta_ad_insights where day >= date '2025-12-25' group by 1) select a.ad_id, coalesce(i, 0) = 0 as flag from a left join w using (ad_id)")
def c1g_no_delivery(t: Tables):
    week = F.sum(F.when(F.col("day") >= "2025-12-25", F.col("impressions")))
    return t.meta_ad_insights.groupBy("ad_id").agg((F.coalesce(week, F.lit(0)) == 0).alias("flag"))


_RANK = "case tier when 'fellowship' then 1 when 'discipleship' then 2 when 'partnership' then 3 when 'leadership' then 4 else 0 end"


@query(f"with k as (select lower({_EMAIL}) e, id, display_name, tier, first_seen_at, phone, created_at from pursuit_people where {_EMAIL} is not null) select e as email, arg_min(display_name, (created_at, id)) filter (where display_name is not null) as name, arg_min(phone, (created_at, id)) filter (where phone is not null) as phone, cast(max({_RANK}) as integer) as rank, min(first_seen_at) as first_seen_at from k group by 1")
def c2_merge(t: Tables):
    """Rows of one key merged: blanks filled in order of arrival, the highest rank, the earliest time."""
    rows = t.pursuit_people.select(text.norm_email(F.col("email")).alias("email"), "id", "display_name", "phone", "first_seen_at", "created_at", text.ranked(F.col("tier"), TIERS).alias("rank")).where("email is not null")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("created_at", "id")))
    return rows.groupBy("email").agg(first("display_name").alias("name"), first("phone").alias("phone"), F.max("rank").alias("rank"), F.min("first_seen_at").alias("first_seen_at"))


@query(f"select state, cast(count(*) as bigint) as people, cast(count(*) filter (where dormant_from is not null) as bigint) as dated from (select {_CLOCK} as state, case when {_CLOCK} = 'dormant' then seen + interval 180 day end dormant_from from (select p, max(seen) seen from ({_SIGNALS}) where p is not null and seen is not null group by 1)) group by 1")
def c2_states(t: Tables):
    who = last_signal(t).withColumn("state", clock_state(F.col("at"), F.expr(NOW_AT)))
    since = F.when(F.col("state") == "dormant", F.col("at") + F.expr("interval 180 day"))
    return who.groupBy("state").agg(F.count(F.lit(1)).alias("people"), F.count(since).alias("dated"))


@query(f"with h as (select lower(display_name) k, id, min(created_at) seen from pursuit_people where display_name is not null and not coalesce(deceased, false) and state <> 'archived' group by 1, 2), f as (select k, arg_min(id, (seen, id)) one from h group by 1) select least(one, h.id) as a, greatest(one, h.id) as b, 0.3 as confidence from h join f using (k) where h.id <> one")
def c2_pairs(t: Tables):
    """Living people of one name, as unordered pairs around the first."""
    p = star_pairs(living(t).withColumn("k", F.lower("display_name")), "k", "id", [F.col("created_at")])
    return p.select(F.least("first", "other").alias("a"), F.greatest("first", "other").alias("b"), F.lit(0.3).alias("confidence"))


@query("select person_id, arg_min(card_id, (created_at, card_id)) as card_id, arg_min(stage, (created_at, card_id)) as stage from pursuit_cards where person_id is not null and not coalesce(archived, false) and created_at is not null group by 1")
def c2_live_cases(t: Tables):
    rows = t.pursuit_cards.where("person_id is not null and not coalesce(archived, false) and created_at is not null").select("person_id", "card_id", "stage", "created_at")
    return first_of_each(rows, ["person_id"], [F.col("created_at"), F.col("card_id")]).select("person_id", "card_id", "stage")


@query(_SERIES)
def c3_month_series(t: Tables):
    return j11_months_and_series(t)


@query(f"with s as (select unnest(generate_series(1, 7)) step), h as (select step, count(*) n from (select {_LADDER} step from pursuit_people where not coalesce(deceased, false) and state <> 'archived') group by 1) select cast(s.step as integer) as step, cast(coalesce(n, 0) as bigint) as n from s left join h using (step)")
def c3_recency_histogram(t: Tables):
    counts = living(t).groupBy(recency_step(F.col("last_signal_at")).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return t.spark.range(1, 8).select(F.col("id").cast("int").alias("step")).join(counts, "step", "left").select("step", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"select id, round(cast(epoch_us(timestamp '2026-01-01') - epoch_us(first_seen_at) as double) / 2629800000000, 1) as months, cast({_RANK} as integer) as rank, cast(coalesce(floor((epoch_us(timestamp '2026-01-01') - epoch_us(last_signal_at)) / 86400000000.0), -1) as integer) as quiet from pursuit_people where not coalesce(deceased, false) and state <> 'archived'")
def c3_points(t: Tables):
    return living(t).select("id", times.age_months(F.col("first_seen_at"), F.expr(NOW_AT)).alias("months"), text.ranked(F.col("tier"), TIERS).alias("rank"), times.days_since(F.col("last_signal_at"), F.expr(NOW_AT)).alias("quiet"))


@query("""with need as (select count(distinct event_type) n from events), u as (select user_id, count(distinct event_type) filter (where ts >= timestamp '2024-01-20') done, max(ts) seen from events group by 1)
 select user_id, cast(done as bigint) as done, done = n as complete, cast(floor((epoch_us(timestamp '2024-02-01') - epoch_us(seen)) / 86400000000.0) as integer) as quiet from u, need""")
def c4_course_progress(t: Tables):
    recent = F.col("ts") >= F.expr("timestamp_ntz'2024-01-20'")
    by = t.events.groupBy("user_id").agg(F.count_distinct(F.when(recent, F.col("event_type"))).alias("done"), F.max("ts").alias("seen"))
    need = t.events.agg(F.count_distinct("event_type")).scalar()
    return by.select("user_id", "done", (F.col("done") == need).alias("complete"), times.days_since(F.col("seen"), F.expr("timestamp_ntz'2024-02-01'")).alias("quiet"))


@query(f"""with g as (select coalesce({_GIVER}, nullif(lower(donor_email), '')) k, amount_cents, received_at from giving_gifts where received_at is not null), f as (select k, min(received_at) first_at from g where k is not null group by 1)
 select cast(date_trunc('week', g.received_at) as date) as week, cast(count(*) as bigint) as gifts, cast(sum(amount_cents) as bigint) as cents, cast(count(*) filter (where g.received_at = f.first_at) as bigint) as firsts from g left join f using (k) group by 1""")
def c5_giving_weeks(t: Tables):
    """Weeks of giving over all gifts, keyless ones included, and how many first gifts they hold."""
    rows = gifts(t).where("received_at is not null").withColumn("k", F.coalesce("giver", F.nullif(F.lower("donor_email"), F.lit(""))))
    first = rows.where("k is not null").groupBy("k").agg(F.min("received_at").alias("first_at"))
    return rows.join(first, "k", "left").groupBy(F.trunc(F.to_date("received_at"), "week").alias("week")).agg(F.count(F.lit(1)).alias("gifts"), F.sum("amount_cents").alias("cents"), F.count_if(F.col("received_at") == F.col("first_at")).alias("firsts"))


@query(f"with {_WEEKS} select campaign_id, cast(sum(spend_now) as double) as spend, cast(sum(results_now) as bigint) as results, round(cast(sum(spend_now) as double) / nullif(sum(results_now), 0), 6) as cost, cast(sum(spend_now) - sum(spend_prior) as double) as more from w group by 1")
def c6_ads_digest(t: Tables):
    return ad_weeks(t).groupBy("campaign_id").agg(F.sum("spend_now").cast("double").alias("spend"), F.sum("results_now").alias("results"), F.round(nested.cost(F.sum("spend_now"), F.sum("results_now")), 6).alias("cost"), (F.sum("spend_now") - F.sum("spend_prior")).cast("double").alias("more"))


@query("select 'leads' as what, cast(count(*) filter (where created_time >= timestamp '2025-12-25') as bigint) as week, cast(count(*) as bigint) as ever from meta_leads union all select 'opportunities', count(*) filter (where created_on >= timestamp '2025-12-25'), count(*) from ghl_opportunities union all select 'cards', count(*) filter (where created_at >= timestamp '2025-12-25'), count(*) from pursuit_cards")
def c7_counts(t: Tables):
    one = lambda df, what, at: df.agg(F.count_if(F.col(at) >= F.expr("timestamp_ntz'2025-12-25'")).alias("week"), F.count(F.lit(1)).alias("ever")).select(F.lit(what).alias("what"), "week", "ever")
    return one(t.meta_leads, "leads", "created_time").unionByName(one(t.ghl_opportunities, "opportunities", "created_on")).unionByName(one(t.pursuit_cards, "cards", "created_at"))


@query("""select l.month, cast(l.n as bigint) as leads, cast(coalesce(o.n, 0) as bigint) as opportunities, cast(l.n - coalesce(o.n, 0) as bigint) as leak from (select strftime(created_time, '%Y-%m') as month, count(distinct lead_id) n from meta_leads where created_time is not null group by 1) l left join (select strftime(created_on, '%Y-%m') as month, count(distinct opp_id) n from ghl_opportunities group by 1) o using (month)""")
def c9_lead_leak(t: Tables):
    by = lambda df, at, key, name: df.where(F.col(at).isNotNull()).groupBy(times.month_text(F.col(at)).alias("month")).agg(F.count_distinct(key).alias(name))
    both = by(t.meta_leads, "created_time", "lead_id", "leads").join(by(t.ghl_opportunities, "created_on", "opp_id", "opportunities"), "month", "left")
    return both.select("month", "leads", F.coalesce("opportunities", F.lit(0)).alias("opportunities"), (F.col("leads") - F.coalesce("opportunities", F.lit(0))).alias("leak"))


def opening(values: pd.Series) -> list:
    """A stand-in for a model: the first words of a text and their number."""
    return [None if not isinstance(v, str) else {"head": " ".join(w[:3]), "words": len(w)} for v in values for w in [re.findall(r"[^ \t\n\r\f\v]+", v) if isinstance(v, str) else []]]


@query(r"""select doc_id, case when text is not null then array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1:3], ' ') end as head, cast(case when text is not null then len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) end as bigint) as words from documents""")
def m10_opaque_rows(t: Tables):
    return mapped_rows(t.documents, "doc_id", "text", "head string, words bigint", opening)


@query("select campaign_id, cast(null as varchar) as advice from meta_ad_insights group by 1")
def m10_no_model(t: Tables):
    return mapped_rows(t.meta_ad_insights.groupBy("campaign_id").agg(F.first("campaign_name").alias("name")), "campaign_id", "name", "advice string")


#: A set of rules to show the engine with: code, signal, threshold, window in days, rank, enabled.
RULES = [("G10", "gift", 10, 730, 3, True), ("G1", "gift", None, None, 0, True), ("C1", "group", None, None, 2, True), ("S2", "serving", 1, 365, 3, True), ("R1", "registration", 1, 90, 1, True), ("OFF", "gift", 1, None, 4, False)]
_RULES = "rules as (select * from (values " + ", ".join(f"('{c}', '{s}', {'null' if t is None else t}, {'null' if w is None else w}, {r}, {str(e).lower()})" for c, s, t, w, r, e in RULES) + ") r(code, signal, threshold, window_days, rank, enabled))"
_FIRED = f"""{_RULES}, e as (select p who, source signal, seen from ({_SIGNALS}) where p is not null and seen is not null),
 hits as (select who, code, rank, count(*) n from e join rules using (signal) where enabled and (window_days is null or cast(seen as date) > date '2026-01-01' - cast(window_days as integer)) group by who, code, rank, threshold having count(*) >= coalesce(threshold, 1))"""


def rule_hits(t: Tables, rules: list = RULES) -> DataFrame:
    table = t.spark.createDataFrame(rules, "code string, signal string, threshold int, window_days int, rank int, enabled boolean")
    return fired(table, signals(t).select(F.col("person").alias("who"), F.col("source").alias("signal"), "at"), F.expr(NOW_AT))


@query(f"with {_FIRED} select who, code, cast(n as bigint) as n from hits")
def c8_rules_fired(t: Tables):
    return rule_hits(t).select("who", "code", "n")


@query(f"with {_FIRED} select who, cast(max(rank) as integer) as rank, string_agg(code, ',' order by code) as reasons from hits group by 1")
def c8_verdicts(t: Tables):
    return verdicts(rule_hits(t)).select("who", "rank", F.array_join("reasons", ",").alias("reasons"))


@query(f"with {_FIRED} select code, cast(count(*) as bigint) as people from hits group by 1")
def c8_preview(t: Tables):
    """What if: how many people each rule would meet, without a verdict written."""
    return rule_hits(t).groupBy("code").agg(F.count(F.lit(1)).alias("people"))


@query(f"""with {_FIRED}, v as (select who, max(rank) rank from hits group by 1) select p.id, cast(case when p.pinned_by is not null then {_RANK.replace('tier', 'p.tier')} else greatest({_RANK.replace('tier', 'p.tier')}, coalesce(v.rank, 0)) end as integer) as rank,
 case when p.state = 'archived' then 'archived' else {_CLOCK.replace('seen', 'p.last_signal_at')} end as state from pursuit_people p left join v on v.who = {plain_sql('p.pco_person_id')}""")
def c2_written(t: Tables):
    """Stored people after a run: a pin holds, a rank never falls, an archived one stays so."""
    ranks = verdicts(rule_hits(t)).select(F.col("who").alias("k"), F.col("rank").alias("earned"))
    people = t.pursuit_people.withColumns({"k": plain_id(F.col("pco_person_id")), "held": text.ranked(F.col("tier"), TIERS)}).join(ranks, "k", "left")
    rank = F.when(F.col("pinned_by").isNotNull(), F.col("held")).otherwise(F.greatest("held", F.coalesce("earned", F.lit(0))))
    return people.select("id", rank.alias("rank"), F.when(F.col("state") == "archived", "archived").otherwise(clock_state(F.col("last_signal_at"), F.expr(NOW_AT))).alias("state"))


@query(f"""with m as ({_SERIES}), h as (select {_LADDER} step, count(*) n from pursuit_people where not coalesce(deceased, false) and state <> 'archived' group by 1)
 select '{{"months":[' || (select string_agg('{{"month":"' || strftime(month, '%Y-%m') || '","gifts":' || gifts || ',"leads":' || leads || '}}', ',' order by month) from m) || '],"steps":[' || (select string_agg('[' || step || ',' || n || ']', ',' order by step) from h) || ']}}' as doc""")
def c3_document(t: Tables):
    """Series and histogram in one JSON document; its lists are as long as the calendar, not the tables."""
    months = j11_months_and_series(t).agg(F.array_sort(F.collect_list(F.struct(times.month_text(F.col("month")).alias("month"), "gifts", "leads"))).alias("months"))
    steps = living(t).groupBy(recency_step(F.col("last_signal_at")).alias("step")).agg(F.count(F.lit(1)).alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "n"))), lambda s: F.array(s["step"].cast("bigint"), s["n"])).alias("steps"))
    return t.spark.range(1).select(F.to_json(F.struct(months.scalar().alias("months"), steps.scalar().alias("steps"))).alias("doc"))
