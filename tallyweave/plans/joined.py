"""Joins and set operations over the tables of the domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ids import plain_id
from ..operators.relations import cascade_join, first_of_each, monthly_series, star_pairs, with_flags
from .book import Book, Tables
from .general import plain_sql
from .scalars import strip

book = Book()
query = book.query



def roster(t: Tables) -> DataFrame:
    """One row per person id: the last re-sync."""
    return t.pco_people.groupBy("pco_person_id").agg(F.max(F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp_ntz")), "name", "email", "phone")).alias("r")).select("pco_person_id", "r.name", "r.email", "r.phone")


_R = """roster as (select pco_person_id, r.name, r.email, r.phone from (select pco_person_id, max({'u': coalesce(updated_at, timestamp '1900-01-01'), 'name': name, 'email': email, 'phone': phone}) r from pco_people group by 1))"""


@query("""select a.ad_id, a.day, c.campaign_name, b.first_day from (select distinct ad_id, day, campaign_id from meta_ad_insights) a
 left join (select campaign_id, min(campaign_name) campaign_name from meta_ad_insights group by 1) c using (campaign_id) left join (select ad_id, min(day) first_day from meta_ad_insights group by 1) b using (ad_id)""")
def j1_two_lookups(t: Tables):
    facts = t.meta_ad_insights
    names = facts.groupBy("campaign_id").agg(F.min("campaign_name").alias("campaign_name"))
    begun = facts.groupBy("ad_id").agg(F.min("day").alias("first_day"))
    return facts.select("ad_id", "day", "campaign_id").distinct().join(names, "campaign_id", "left").join(begun, "ad_id", "left").select("ad_id", "day", "campaign_name", "first_day")


@query("""select household_id, arg_min(phone, (child, pco_person_id)) as phone from (select household_id, coalesce(child, false) child, pco_person_id, phone from pco_people where household_id is not null and phone is not null) group by 1""")
def j2_primary_else_first(t: Tables):
    held = t.pco_people.where("household_id is not null and phone is not null")
    return held.groupBy("household_id").agg(F.min(F.struct(F.coalesce("child", F.lit(False)).alias("c"), "pco_person_id", "phone")).alias("m")).select("household_id", "m.phone")


@query(f"""with {_R} select g.gift_id, g.created_at, coalesce(nullif(g.donor_name, ''), r.name) as name from giving_gifts g left join roster r on r.pco_person_id = {plain_sql('g.pco_person_id')}""")
def j3_names_of_gifts(t: Tables):
    names = roster(t).select(F.col("pco_person_id").alias("k"), "name")
    gifts = t.giving_gifts.withColumn("k", plain_id(F.col("pco_person_id")))
    return gifts.join(names, "k", "left").select("gift_id", "created_at", F.coalesce(text.filled(F.col("donor_name")), "name").alias("name"))


@query("""select l.lead_id, a.ad_name, c.objective from (select distinct lead_id, ad_id from meta_leads where ad_id is not null) l
 join (select ad_id, min(ad_name) ad_name, min(campaign_id) campaign_id from meta_ad_insights group by 1) a using (ad_id) join (select campaign_id, min(objective) objective from meta_ad_insights group by 1) c using (campaign_id)""")
def j4_chain(t: Tables):
    ads = t.meta_ad_insights.groupBy("ad_id").agg(F.min("ad_name").alias("ad_name"), F.min("campaign_id").alias("campaign_id"))
    campaigns = t.meta_ad_insights.groupBy("campaign_id").agg(F.min("objective").alias("objective"))
    return t.meta_leads.where("ad_id is not null").select("lead_id", "ad_id").distinct().join(ads, "ad_id").join(campaigns, "campaign_id").select("lead_id", "ad_name", "objective")


@query(f"""with {_R} select p.id, coalesce(p.email, r.email) as email from pursuit_people p left join roster r on r.pco_person_id = p.pco_person_id""")
def j5_email_by_id(t: Tables):
    side = roster(t).select("pco_person_id", F.col("email").alias("known"))
    return t.pursuit_people.join(side, "pco_person_id", "left").select("id", F.coalesce("email", "known").alias("email"))


@query(f"""with {_R}, leads as (select distinct {plain_sql('pco_person_id')} k from pco_group_memberships where lower(role) = 'leader') select r.pco_person_id, r.email from leads join roster r on r.pco_person_id = leads.k where r.email is not null""")
def j6_filtered_role(t: Tables):
    leaders = t.pco_group_memberships.where(F.lower("role") == "leader").select(plain_id(F.col("pco_person_id")).alias("pco_person_id")).distinct()
    return roster(t).join(leaders, "pco_person_id", "left_semi").where("email is not null").select("pco_person_id", "email")


_EMAIL = f"case when position('@' in lower({strip('email')})) > 0 and position('.' in split_part(lower({strip('email')}), '@', -1)) > 0 then lower({strip('email')}) end"
_PHONE = "case when length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 then right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) end"


@query(f"""with l as (select distinct lead_id, {_EMAIL} e, {_PHONE} p from meta_leads), people as (select id, {_EMAIL} e, {_PHONE} p from pursuit_people),
 es as (select e, min(id) id from people where e is not null group by 1), ps as (select p, min(id) id from people where p is not null group by 1)
 select l.lead_id, coalesce(es.id, ps.id) as id, cast(case when es.id is not null then 1 when ps.id is not null then 2 end as integer) as step from l left join es on es.e = l.e left join ps on ps.p = l.p""")
def j7_cascade_match(t: Tables):
    keyed = lambda df, key: df.select(key, text.norm_email(F.col("email")).alias("e"), text.norm_phone(F.col("phone")).alias("p")).distinct()
    return cascade_join(keyed(t.meta_leads, "lead_id"), keyed(t.pursuit_people, "id"), "lead_id", "id", [("e", "e"), ("p", "p")])


@query("""select ad_id, cast(coalesce(sum(spend) filter (where day >= date '2025-12-25'), 0) as double) as now, cast(coalesce(sum(spend) filter (where day < date '2025-12-25'), 0) as double) as prior
 from meta_ad_insights where day >= date '2025-12-18' group by 1""")
def j8_this_and_last_week(t: Tables):
    recent = F.col("day") >= "2025-12-25"
    week = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("spend"))), F.lit(0)).cast("double")
    return t.meta_ad_insights.where("day >= date '2025-12-18'").groupBy("ad_id").agg(week(recent).alias("now"), week(~recent).alias("prior"))


@query("""select a.ad_id from (select distinct ad_id from meta_ad_insights) a left join (select ad_id, sum(impressions) i from meta_ad_insights where day >= date '2025-12-25' group by 1) w using (ad_id) where i is null or i = 0""")
def j9_missing_or_zero(t: Tables):
    week = t.meta_ad_insights.where("day >= date '2025-12-25'").groupBy("ad_id").agg(F.sum("impressions").alias("i"))
    return t.meta_ad_insights.select("ad_id").distinct().join(week, "ad_id", "left").where("i is null or i = 0").select("ad_id")


@query("""select distinct l.lead_id, i.campaign_name from meta_leads l join meta_ad_insights i on i.ad_id = l.ad_id and i.day = cast(l.created_time as date) where i.objective = 'OUTCOME_LEADS'""")
def j10_key_and_literal(t: Tables):
    facts = t.meta_ad_insights.where("objective = 'OUTCOME_LEADS'").select("ad_id", "day", "campaign_name")
    return t.meta_leads.select("lead_id", "ad_id", F.to_date("created_time").alias("day")).join(facts, ["ad_id", "day"]).select("lead_id", "campaign_name").distinct()


_SERIES = """with months as (select cast(unnest(generate_series(date '2024-01-01', date '2025-12-01', interval 1 month)) as date) as month),
 s as (select cast(date_trunc('month', received_at) as date) as month, 1 gifts, amount_cents cents, 0 leads, 0 opps, 0 joined, 0 cards from giving_gifts
 union all select cast(date_trunc('month', created_time) as date), 0, 0, 1, 0, 0, 0 from meta_leads union all select cast(date_trunc('month', created_on) as date), 0, 0, 0, 1, 0, 0 from ghl_opportunities
 union all select cast(date_trunc('month', joined_at) as date), 0, 0, 0, 0, 1, 0 from pco_group_memberships union all select cast(date_trunc('month', created_at) as date), 0, 0, 0, 0, 0, 1 from pursuit_cards)
 select m.month, """ + ", ".join(f"cast(coalesce(sum({c}), 0) as bigint) as {c}" for c in ("gifts", "cents", "leads", "opps", "joined", "cards")) + " from months m left join s on s.month = m.month group by 1"


@query(_SERIES)
def j11_months_and_series(t: Tables):
    one = F.lit(1)
    return monthly_series([
        ("gifts", t.giving_gifts, "received_at", one), ("cents", t.giving_gifts, "received_at", F.col("amount_cents")), ("leads", t.meta_leads, "created_time", one),
        ("opps", t.ghl_opportunities, "created_on", one), ("joined", t.pco_group_memberships, "joined_at", one), ("cards", t.pursuit_cards, "created_at", one),
    ], "2024-01-01", 24)


_FLAGS = f"""select p.pco_person_id, exists (select 1 from giving_gifts g where {plain_sql('g.pco_person_id')} = p.pco_person_id) as gives,
 exists (select 1 from pco_group_memberships m where {plain_sql('m.pco_person_id')} = p.pco_person_id) as grouped,
 exists (select 1 from giving_gifts g where {plain_sql('g.pco_person_id')} = p.pco_person_id and g.received_at > timestamp '2025-10-03') as lately from (select distinct pco_person_id from pco_people) p"""


def flagged(t: Tables) -> DataFrame:
    key = plain_id(F.col("pco_person_id")).alias("pco_person_id")
    return with_flags(
        t.pco_people.select("pco_person_id").distinct(), "pco_person_id", gives=t.giving_gifts.select(key), grouped=t.pco_group_memberships.select(key),
        lately=t.giving_gifts.where("received_at > timestamp_ntz'2025-10-03'").select(key),
    )


@query(_FLAGS)
def j12_existence_flags(t: Tables):
    return flagged(t)


@query(f"""select distinct l.lead_id from meta_leads l where not exists (select 1 from pursuit_people p where {_EMAIL.replace('email', 'p.email')} = {_EMAIL.replace('email', 'l.email')})""")
def j13_new_rows(t: Tables):
    known = t.pursuit_people.select(text.norm_email(F.col("email")).alias("e"))
    return t.meta_leads.select("lead_id", text.norm_email(F.col("email")).alias("e")).join(known, "e", "left_anti").select("lead_id").distinct()


@query(f"""select o.e as email, o.opp_id from (select {_EMAIL} e, arg_min(opp_id, (created_on, opp_id)) opp_id from ghl_opportunities where {_EMAIL} is not null group by 1) o where not exists (select 1 from pursuit_people p where {_EMAIL.replace('email', 'p.email')} = o.e)""")
def j14_first_for_those_without(t: Tables):
    offered = t.ghl_opportunities.select(text.norm_email(F.col("email")).alias("email"), "opp_id", "created_on").where("email is not null")
    known = t.pursuit_people.select(text.norm_email(F.col("email")).alias("email"))
    return first_of_each(offered.join(known, "email", "left_anti"), ["email"], [F.col("created_on"), F.col("opp_id")]).select("email", "opp_id")


@query(f"""select distinct {plain_sql('g.pco_person_id')} as giver from giving_gifts g where {plain_sql('g.pco_person_id')} in (select {plain_sql('pco_person_id')} from pco_group_memberships where lower(role) = 'leader' and pco_person_id is not null)""")
def j15_semi(t: Tables):
    leaders = t.pco_group_memberships.where(F.lower("role") == "leader").select(plain_id(F.col("pco_person_id")).alias("giver"))
    return t.giving_gifts.select(plain_id(F.col("pco_person_id")).alias("giver")).distinct().join(leaders, "giver", "left_semi")


@query("""select distinct person_id, stage from pursuit_cards c where person_id is not null and not exists (select 1 from pursuit_cards a where a.archived and a.person_id = c.person_id and a.stage = c.stage)""")
def j16_anti_on_two_keys(t: Tables):
    done = t.pursuit_cards.where("archived").select("person_id", "stage")
    return t.pursuit_cards.where("person_id is not null").select("person_id", "stage").distinct().join(done, ["person_id", "stage"], "left_anti")


@query("""select a.action_type, cast(count(*) as bigint) as n from meta_ad_insights, unnest(actions) as u(a) group by 1""")
def j17_unnested(t: Tables):
    return t.meta_ad_insights.select(F.explode("actions").alias("a")).groupBy("a.action_type").agg(F.count(F.lit(1)).alias("n"))


@query("""with h as (select lower(display_name) k, id, min(created_at) seen from pursuit_people where display_name is not null group by 1, 2), f as (select k, arg_min(id, (seen, id)) first from h group by 1)
 select h.k as name, f.first, h.id as other from h join f using (k) where h.id <> f.first""")
def j18_name_pairs(t: Tables):
    return star_pairs(t.pursuit_people.withColumn("name", F.lower("display_name")), "name", "id", [F.col("created_at")])


@query(f"""with c as (select distinct person_id from pursuit_cards where stage = 'planned_visit' and person_id is not null), a as (select distinct person_id from pursuit_cards where stage in ('attended', 'returned') and person_id is not null)
 select coalesce(c.person_id, a.person_id) as person_id, case when a.person_id is null then 'no show' when c.person_id is null then 'walk-in' else 'attended' end as outcome from c full join a on a.person_id = c.person_id""")
def j19_matched_and_residues(t: Tables):
    side = lambda cond, flag: t.pursuit_cards.where(cond).where("person_id is not null").select("person_id").distinct().withColumn(flag, F.lit(True))
    both = side(F.col("stage") == "planned_visit", "planned").join(side(F.col("stage").isin("attended", "returned"), "came"), "person_id", "full_outer")
    return both.select("person_id", F.when(F.col("came").isNull(), "no show").when(F.col("planned").isNull(), "walk-in").otherwise("attended").alias("outcome"))


# Set operations.


@query("""select kind, cast(count(*) as bigint) as n from (select 'lead' kind, created_time from meta_leads union all select 'opportunity', created_on from ghl_opportunities where lower(coalesce(stage, '')) in ('attended', 'confirmed')) group by 1""")
def u1_union_all(t: Tables):
    leads = t.meta_leads.select(F.lit("lead").alias("kind"), F.col("created_time").alias("at"))
    opps = t.ghl_opportunities.where(F.lower(F.coalesce("stage", F.lit(""))).isin("attended", "confirmed")).select(F.lit("opportunity").alias("kind"), F.col("created_on").alias("at"))
    return leads.unionByName(opps).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def evidence(t: Tables) -> DataFrame:
    """One stream of evidence about people from six sources: source, its rank, record, ids, contacts and time."""
    src = lambda rank, name, df, rec, at, **has: df.select(F.lit(rank).alias("source_rank"), F.lit(name).alias("source"), F.col(rec).alias("record"), F.col(at).alias("at"), *[c.alias(k) for k, c in has.items()])
    e, p, pid = text.norm_email(F.col("email")), text.norm_phone(F.col("phone")), plain_id(F.col("pco_person_id"))
    parts = [
        src(1, "roster", t.pco_people, "pco_person_id", "created_at", pco=pid, email=e, phone=p), src(2, "person", t.pursuit_people, "id", "created_at", pco=pid, email=e, phone=p),
        src(3, "group", t.pco_group_memberships, "membership_id", "joined_at", pco=pid), src(4, "gift", t.giving_gifts, "gift_id", "received_at", pco=pid, email=text.norm_email(F.col("donor_email"))),
        src(5, "opportunity", t.ghl_opportunities, "opp_id", "created_on", email=e, phone=p), src(6, "lead", t.meta_leads, "lead_id", "created_time", email=e, phone=p),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query(f"""select source, cast(count(*) as bigint) as n, cast(count(pco) as bigint) as with_id, cast(count(email) as bigint) as with_email, cast(count(phone) as bigint) as with_phone from (
 select 'roster' source, {plain_sql('pco_person_id')} pco, {_EMAIL} email, {_PHONE} phone from pco_people union all select 'person', {plain_sql('pco_person_id')}, {_EMAIL}, {_PHONE} from pursuit_people
 union all select 'group', {plain_sql('pco_person_id')}, null, null from pco_group_memberships union all select 'gift', {plain_sql('pco_person_id')}, {_EMAIL.replace('email', 'donor_email')}, null from giving_gifts
 union all select 'opportunity', null, {_EMAIL}, {_PHONE} from ghl_opportunities union all select 'lead', null, {_EMAIL}, {_PHONE} from meta_leads) group by 1""")
def u2_evidence_stream(t: Tables):
    return evidence(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("pco").alias("with_id"), F.count("email").alias("with_email"), F.count("phone").alias("with_phone"))


_TWO = """with a as (select distinct group_id, pco_person_id p from pco_group_memberships where pco_person_id is not null), b as (select distinct pco_person_id p from giving_gifts where pco_person_id is not null)"""


def _members_givers(t: Tables):
    return t.pco_group_memberships.where("pco_person_id is not null").select("group_id", "pco_person_id").distinct(), t.giving_gifts.where("pco_person_id is not null").select("pco_person_id").distinct()


@query(_TWO + " select group_id, cast(count(b.p) as bigint) as giving_members from a left join b using (p) group by 1")
def u3_intersection(t: Tables):
    members, givers = _members_givers(t)
    return members.join(givers.withColumn("gives", F.lit(1)), "pco_person_id", "left").groupBy("group_id").agg(F.count("gives").alias("giving_members"))


@query(_TWO + " select p as pco_person_id from a union select p from b")
def u4_union_distinct(t: Tables):
    members, givers = _members_givers(t)
    return members.select("pco_person_id").union(givers).distinct()


@query(_TWO + " select group_id, count(b.p) = count(*) as all_give from a left join b using (p) group by 1")
def u5_subset(t: Tables):
    members, givers = _members_givers(t)
    return members.join(givers.withColumn("gives", F.lit(1)), "pco_person_id", "left").groupBy("group_id").agg((F.count("gives") == F.count(F.lit(1))).alias("all_give"))


@query("""select distinct campaign_id, objective from meta_ad_insights""")
def u6_distinct(t: Tables):
    return t.meta_ad_insights.select("campaign_id", "objective").distinct()


@query(_TWO + " select p as pco_person_id from b except select p from a")
def u7_difference(t: Tables):
    members, givers = _members_givers(t)
    return givers.join(members, "pco_person_id", "left_anti")
