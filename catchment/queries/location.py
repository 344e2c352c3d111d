"""Location models over the siting tables."""

from pyspark.sql import functions as F

from ..location import cover, genetic, pcenter, pmedian, relation, sweep
from ..operators import network
from ..operators.nearest import nearest_site
from .joins import ROAD_PATHS, SNAP
from .registry import hav, query

DC = ("demand", "candidates")
OD = f"od as materialized (select d.aoi_id, d.demand_id, c.site_id, d.weight, c.cost, c.capacity, c.reliability, {hav('d', 'c')} as dist from demand d join candidates c using (aoi_id))"


def _greedy_parts(p: int, t: str = "", od: str = "od", demand: str = "demand") -> list[str]:
    """Unrolled greedy rounds: state bN (distance after N picks), costs cN, pick pN."""
    parts = [f"{t}b0 as materialized (select aoi_id, demand_id, weight, 3e7 as d1 from {demand})"]
    for i in range(1, p + 1):
        done = " union all ".join(f"select aoi_id, site_id from {t}p{j}" for j in range(1, i)) or "select '' as aoi_id, -1 as site_id"
        parts.append(
            f"{t}c{i} as materialized (select aoi_id, site_id, round(sum({od}.weight*least(b.d1, {od}.dist)), 0) as cost from {od} join {t}b{i-1} b using (aoi_id, demand_id)"
            f" where (aoi_id, site_id) not in ({done}) group by 1, 2)"
        )
        parts.append(f"{t}p{i} as materialized (select aoi_id, arg_min(site_id, (cost, site_id)) as site_id, min(cost) as cost from {t}c{i} group by 1)")
        parts.append(
            f"{t}b{i} as materialized (select b.aoi_id, b.demand_id, b.weight, least(b.d1, coalesce({od}.dist, b.d1)) as d1 from {t}b{i-1} b left join {t}p{i} q using (aoi_id)"
            f" left join {od} on {od}.aoi_id=b.aoi_id and {od}.demand_id=b.demand_id and {od}.site_id=q.site_id)"
        )
    return parts


def _greedy_sql(p: int) -> str:
    out = " union all ".join(f"select aoi_id, {i} as step, site_id, cost from p{i}" for i in range(1, p + 1))
    return "with " + ", ".join([OD] + _greedy_parts(p)) + " " + out


def _drop_one_sql() -> str:
    """The re-solves run over keys 'area|dropped site'."""
    parts = [OD] + _greedy_parts(2) + [
        "gone as (select aoi_id, site_id as dropped from p1 union all select aoi_id, site_id from p2)",
        "od2 as materialized (select concat(od.aoi_id, '|', dropped) as aoi_id, demand_id, site_id, weight, dist from od join gone on gone.aoi_id=od.aoi_id where site_id <> dropped)",
        "dem2 as materialized (select concat(d.aoi_id, '|', dropped) as aoi_id, demand_id, weight from demand d join gone using (aoi_id))",
    ] + _greedy_parts(2, "x", "od2", "dem2") + [
        "last as (select aoi_id, arg_max(cost, step) as cost from (select aoi_id, 1 as step, cost from xp1 union all select aoi_id, 2, cost from xp2) group by 1)",
        "base as (select aoi_id, round(sum(weight*d1), 0) as base_cost from b2 group by 1)",
        "o as (select g.aoi_id, dropped, l.cost, base_cost, round((l.cost-base_cost)/abs(base_cost)*100e0, 6) as degradation_pct from gone g join base using (aoi_id) left join last l on l.aoi_id=concat(g.aoi_id, '|', dropped))",
    ]
    return "with " + ", ".join(parts) + " select *, row_number() over (partition by aoi_id order by degradation_pct desc nulls last, dropped) as rank from o"


def _center_sql(p: int, weighted: bool, existing: bool) -> str:
    """Unrolled farthest-first rounds and the nearest-candidate bound."""
    w = "b.weight*b.d1" if weighted else "b.d1"
    start = "(select dist from od where od.aoi_id=d.aoi_id and od.demand_id=d.demand_id and od.site_id=f.site_id)" if existing else "3e7"
    parts = [OD, "f as (select aoi_id, min(site_id) as site_id from candidates group by 1)",
             f"b0 as materialized (select d.aoi_id, d.demand_id, d.weight, d.lon, d.lat, {start} as d1 from demand d join f using (aoi_id))"]
    done = "select aoi_id, site_id from f" if existing else "select '' as aoi_id, -1 as site_id"
    for i in range(1, p + 1):
        parts.append(f"w{i} as materialized (select aoi_id, arg_max(demand_id, (round({w}, 3), -demand_id)) as demand_id from b{i-1} b group by 1)")
        parts.append(f"p{i} as materialized (select od.aoi_id, arg_min(od.site_id, (dist, od.site_id)) as site_id from od join w{i} using (aoi_id, demand_id) where (od.aoi_id, od.site_id) not in ({done}) group by 1)")
        parts.append(f"b{i} as materialized (select b.aoi_id, b.demand_id, b.weight, least(b.d1, coalesce(od.dist, b.d1)) as d1 from b{i-1} b left join p{i} q using (aoi_id) left join od on od.aoi_id=b.aoi_id and od.demand_id=b.demand_id and od.site_id=q.site_id)")
        done += f" union all select aoi_id, site_id from p{i}"
    best = "weight*m" if weighted else "m"
    return ("with " + ", ".join(parts) + f" select aoi_id, objective, lower_bound from (select aoi_id, max(round({w}, 3)) as objective from b{p} b group by 1) join (select aoi_id, round(max({best}), 3) as lower_bound from"
            " (select aoi_id, demand_id, any_value(weight) as weight, min(dist) as m from od group by 1, 2) group by 1) using (aoi_id)")


@query("p_median_greedy", _greedy_sql(3), DC)
def p_median_greedy(v):
    return pmedian.p_median_greedy(v.demand(), v.candidates(), 3)


R = 10000.0
COV = "cov as materialized (select * from od where dist <= 10000)"


def _cover_sql(p: int, coef: str = "1e0", need: str = "1e0", gain: str = "", radius: str = "10000") -> str:
    """Unrolled rounds of gain = weight * min(need, coef)."""
    gain = gain or f"weight*least(need, {coef})"
    parts = [OD, COV.replace("10000", radius), f"n0 as materialized (select aoi_id, demand_id, {need} as need from demand)"]
    for i in range(1, p + 1):
        done = " union all ".join(f"select aoi_id, site_id from p{j}" for j in range(1, i)) or "select '' as aoi_id, -1 as site_id"
        parts.append(
            f"g{i} as materialized (select aoi_id, site_id, round(sum({gain}), 4) as gain from cov join n{i-1} using (aoi_id, demand_id)"
            f" where need > 1e-9 and (aoi_id, site_id) not in ({done}) group by 1, 2)"
        )
        parts.append(f"p{i} as materialized (select aoi_id, arg_min(site_id, (-gain, site_id)) as site_id, max(gain) as gain from g{i} group by 1)")
        parts.append(
            f"n{i} as materialized (select n.aoi_id, n.demand_id, n.need - coalesce({coef}, 0e0) as need from n{i-1} n left join p{i} using (aoi_id)"
            f" left join cov on cov.aoi_id=n.aoi_id and cov.demand_id=n.demand_id and cov.site_id=p{i}.site_id)".replace(
                "coalesce(1e0, 0e0)", "case when cov.site_id is null then 0e0 else 1e0 end")
        )
    out = " union all ".join(f"select aoi_id, {i} as step, site_id, gain from p{i}" for i in range(1, p + 1))
    return "with " + ", ".join(parts) + " " + out


@query("mclp_greedy", _cover_sql(3), DC)
def mclp_greedy(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"])
    return cover.greedy_p(pairs, 3)


@query("mclp_probabilistic", _cover_sql(3, "reliability"), DC)
def mclp_probabilistic(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"], coef=F.col("reliability"))
    return cover.greedy_p(pairs, 3)


def _cover_cte(radius: str, need: str = "1e0", coef: str = "1e0", value: str = "1e0", seed: str = "null") -> str:
    """Recursive greedy cover and recursive closing of redundant sites, one site per step."""
    return f"""{OD}, cov as materialized (select aoi_id, demand_id, site_id, {value} as value, {coef} as coef from od where dist <= {radius}),
 greedy(aoi_id, n, chosen) as (select aoi_id, 0, coalesce(list(site_id) filter (site_id is not null), cast([] as bigint[])) from (select aoi_id, cast({seed} as bigint) as site_id from candidates group by 1) group by 1
  union all select aoi_id, n+1, list_append(chosen, best) from (select aoi_id, any_value(n) as n, any_value(chosen) as chosen, arg_min(site_id, (-gain, site_id)) as best from (
   select u.aoi_id, any_value(u.n) as n, any_value(u.chosen) as chosen, c.site_id, round(sum(c.value*least(u.need, c.coef)), 4) as gain from (
    select g.aoi_id, any_value(g.n) as n, any_value(g.chosen) as chosen, c.demand_id, {need} - coalesce(sum(case when list_contains(g.chosen, c.site_id) then c.coef end), 0e0) as need from greedy g join cov c using (aoi_id) group by g.aoi_id, c.demand_id) u
   join cov c on c.aoi_id=u.aoi_id and c.demand_id=u.demand_id where u.need > 1e-9 and not coalesce(list_contains(u.chosen, c.site_id), false) group by u.aoi_id, c.site_id) group by aoi_id)),
 lean(aoi_id, n, chosen) as (select aoi_id, 0, arg_max(chosen, n) from greedy group by 1
  union all select aoi_id, n+1, list_filter(chosen, lambda x: x <> gone) from (select aoi_id, any_value(n) as n, any_value(chosen) as chosen, arg_max(site_id, (-k, site_id)) as gone from (
   select aoi_id, site_id, any_value(n) as n, any_value(chosen) as chosen, count(*) as k from (
    select l.aoi_id, l.n, l.chosen, c.site_id, c.coef, sum(c.coef) over (partition by l.aoi_id, c.demand_id) as tot from lean l join cov c on c.aoi_id=l.aoi_id and list_contains(l.chosen, c.site_id))
   group by aoi_id, site_id having bool_and(tot - coef >= {need} - 1e-9) and (aoi_id, site_id) not in (select aoi_id, cast({'min(site_id)' if seed != 'null' else '-1'} as bigint) from candidates group by 1)) group by aoi_id)),
 final as (select aoi_id, unnest(arg_max(chosen, n)) as site_id from lean group by 1)"""


@query("lscp_greedy", "with " + _cover_cte("10000") + " select aoi_id, site_id from final", DC, recursive=True)
def lscp_greedy(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"], value=F.lit(1.0))
    got = cover.greedy_cover(pairs)
    return cover.drop_redundant(pairs, got)


@query("lscp_status", "with " + _cover_cte("4000") + """, sp as (select aoi_id, lon, lat, min(demand_id) as demand_id, sum(weight) as w, count(*) as n from demand group by 1,2,3),
 met as (select distinct c.aoi_id, c.demand_id from cov c join final f using (aoi_id, site_id))
 select sp.aoi_id, case when sp.aoi_id not in (select aoi_id from candidates) then 'no candidates' when count(*) filter (met.demand_id is null) > 0 then 'infeasible' else 'feasible' end as status,
  (select count(*) from final f where f.aoi_id = sp.aoi_id) as n_sites, cast(sum(n) as bigint) as n_demand, cast(coalesce(sum(n) filter (met.demand_id is null), 0) as bigint) as n_uncovered,
  round(coalesce(sum(w) filter (met.demand_id is null), 0e0), 4) as uncovered_weight from sp left join met using (aoi_id, demand_id) group by sp.aoi_id""", DC, recursive=True)
def lscp_status(v):
    """Whether a cover exists in every area, and what stays open where it does not."""
    pairs = cover.cover_reach(v.demand(), v.candidates(), 4000.0, ["aoi_id"], value=F.lit(1.0))
    return cover.cover_status(v.demand(), v.candidates(), pairs, cover.drop_redundant(pairs, cover.greedy_cover(pairs)))


@query("p_center")
def p_center(v):
    return pcenter.p_center(v.demand(), v.candidates(), 3)


@query("p_median_swap")
def p_median_swap(v):
    g = pmedian.p_median_greedy(v.demand(), v.candidates(), 3)
    return pmedian.p_median_swap(v.demand(), v.candidates(), g)


@query("p_median_bound")
def p_median_bound(v):
    g = pmedian.p_median_greedy(v.demand(), v.candidates(), 3)
    up = g.groupBy("aoi_id").agg(F.max_by("cost", "step").alias("cost"))
    lb = pmedian.p_median_bound(v.demand(), v.candidates(), 3, up, rounds=4)
    gap = (F.col("cost") - F.col("lower_bound")) / F.col("cost")
    return up.join(lb, "aoi_id").select("aoi_id", "cost", F.round("lower_bound", 0).alias("lower_bound"), F.round(gap, 6).alias("gap"))


def _capacities(v, p, room):
    """Candidates whose capacities keep their ratios and sum, over p average sites, to ``room`` times the demand."""
    tot = v.demand().groupBy("aoi_id").agg(F.sum("weight").alias("_w"))
    avg = v.candidates().groupBy("aoi_id").agg(F.avg("capacity").alias("_avg"))
    c = v.candidates().join(tot, "aoi_id").join(avg, "aoi_id")
    return c.withColumn("capacity", F.round(F.col("capacity") * F.col("_w") * room / (F.col("_avg") * p), 6)).drop("_w", "_avg")


@query("p_median_capacitated")
def p_median_capacitated(v):
    """Sites of unequal capacity, chosen so that they hold all demand; rows without a site come as one group."""
    a = pmedian.p_median_capacitated(v.demand(), _capacities(v, 3, 1.1), 3)[1]
    return a.groupBy("aoi_id", "site_id", "status").agg(F.count(F.lit(1)).alias("n_demand"), F.round(F.sum("weight"), 2).alias("weight"), F.max("dist_m").alias("max_m"))


@query("p_median_budget")
def p_median_budget(v):
    return pmedian.p_median_budget(v.demand(), v.candidates(), 3, 600.0)


@query("p_median_max_distance")
def p_median_max_distance(v):
    return pmedian.p_median_max_distance(v.demand(), v.candidates(), 12, 35000.0)


@query("p_center_weighted", _center_sql(3, True, False), DC)
def p_center_weighted(v):
    return pcenter.p_center_greedy(v.demand(), v.candidates(), 3, weighted=True)[1]


_FIRST = "with f as (select aoi_id, min(site_id) as site_id from candidates group by 1) "


def _first_site(v):
    c = v.candidates()
    first = c.groupBy("aoi_id").agg(F.min("site_id").alias("site_id"))
    return first.join(c, ["aoi_id", "site_id"])


@query("p_center_conditional", _center_sql(2, False, True), DC)
def p_center_conditional(v):
    return pcenter.p_center_greedy(v.demand(), v.candidates(), 2, existing=_first_site(v))[1]


@query("p_center_weighted_search")
def p_center_weighted_search(v):
    return pcenter.p_center(v.demand(), v.candidates(), 3, weighted=True)


@query("p_center_conditional_search")
def p_center_conditional_search(v):
    return pcenter.p_center(v.demand(), v.candidates(), 2, existing=_first_site(v))


_SHUT = "(aoi_id, site_id) not in (select aoi_id, max(site_id) from candidates group by 1 having max(site_id) <> min(site_id))"


def _last_site(v):
    last = v.candidates().groupBy("aoi_id").agg(F.max("site_id").alias("site_id"), F.min("site_id").alias("lo"))
    return last.where("site_id <> lo").select("aoi_id", "site_id")


@query("lscp_forced", "with " + _cover_cte(f"10000 and {_SHUT}", seed="min(site_id)") + " select aoi_id, site_id, (aoi_id, site_id) in (select aoi_id, min(site_id) from candidates group by 1) as forced from final", DC, recursive=True)
def lscp_forced(v):
    """Cover with an area's first site open and its last one shut."""
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"], value=F.lit(1.0))
    return cover.set_cover(pairs, ["aoi_id"], must_open=_first_site(v), must_close=_last_site(v))


@query("p_center_forced")
def p_center_forced(v):
    """Three sites, an area's first one among them and its last one not."""
    return pcenter.p_center(v.demand(), v.candidates(), 3, must_open=_first_site(v), must_close=_last_site(v))


def _step_cte(name: str, carry: str, start: str, gate: str, order: str, grow: str, filt: str = "true") -> str:
    """Recursive rounds over uncovered demand, one site per area and step."""
    return f"""{name}(aoi_id, step, chosen, {carry}, site_id, gain) as (select aoi_id, 0, cast([] as bigint[]), {start}, cast(-1 as bigint), 0e0 from candidates group by 1
  union all select aoi_id, step+1, list_append(chosen, best.site_id), {grow}, best.site_id, best.gain from (select aoi_id, any_value(step) as step, any_value(chosen) as chosen, any_value({carry}) as {carry}, arg_max(struct_pack(site_id := site_id, gain := gain, price := price), {order}) as best from (
   select u.aoi_id, any_value(u.step) as step, any_value(u.chosen) as chosen, any_value(u.{carry}) as {carry}, c.site_id, any_value(c.cost) as price, round(sum(c.weight), 4) as gain from (
    select g.aoi_id, any_value(g.step) as step, any_value(g.chosen) as chosen, any_value(g.{carry}) as {carry}, c.demand_id from {name} g join cov c using (aoi_id) {gate} group by g.aoi_id, c.demand_id having not bool_or(coalesce(list_contains(g.chosen, c.site_id), false))) u
   join cov c on c.aoi_id=u.aoi_id and c.demand_id=u.demand_id group by u.aoi_id, c.site_id) where {filt} group by aoi_id))"""


_PARTIAL = ("with " + OD + ", " + COV + ", goal as (select aoi_id as a, 0.5e0*sum(weight) as goal from demand group by 1), "
            + _step_cte("g", "have", "0e0", "join goal on goal.a=g.aoi_id and round(g.have, 4) < round(goal.goal, 4)", "(gain, -site_id)", "have+best.gain")
            + " select aoi_id, step, site_id, gain from g where step > 0")
_BUDGET = ("with " + OD + ", " + COV + ", " + _step_cte("g", "spent", "0e0", "", "(round(gain/price, 6), -site_id)", "spent+best.price", "spent+price <= 500e0 and gain > 0")
           + """, s as (select aoi_id, site_id, any_value(cost) as price, round(sum(weight), 4) as gain from cov where cost <= 500e0 group by 1, 2), one as (select aoi_id, arg_max(site_id, (gain, -site_id)) as site_id, max(gain) as gain, arg_max(price, (gain, -site_id)) as price from s group by 1),
 tot as (select aoi_id, sum(gain) as t from g where step > 0 group by 1), solo as (select one.* from one join tot using (aoi_id) where one.gain > t)
 select aoi_id, step, site_id, gain, spent from g where step > 0 and aoi_id not in (select aoi_id from solo) union all select aoi_id, 1, site_id, gain, price from solo""")


@query("mclp_budget", _BUDGET, DC, recursive=True)
def mclp_budget(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"])
    return cover.greedy_budget(pairs, v.candidates(), 500.0)


@query("mclp_capacitated")
def mclp_capacitated(v):
    a = cover.greedy_capacity(v.demand(), _capacities(v, 3, 1.0), R, 3)
    return a.groupBy("aoi_id", "step", "site_id").agg(F.count(F.lit(1)).alias("n_demand"), F.round(F.sum("weight"), 2).alias("served"))


@query("mclp_multi", _cover_sql(4, need="2e0", gain="case when need <= 1e0+1e-9 then weight else weight/2e0 end", radius="15000"), DC)
def mclp_multi(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), 15000.0, ["aoi_id"], need=2.0)
    return cover.greedy_p(pairs, 4, gain=cover.multi_gain(2.0))


@query("mclp_bound", _cover_sql(3).rsplit(" select aoi_id, 1 as step", 1)[0] + """, g4 as (select aoi_id, site_id, sum(weight*least(need, 1e0)) as gain from cov join n3 using (aoi_id, demand_id) where need > 1e-9 and (aoi_id, site_id) not in (select aoi_id, site_id from p1 union all select aoi_id, site_id from p2 union all select aoi_id, site_id from p3) group by 1,2),
 t as (select aoi_id, sum(gain) as more from (select *, row_number() over (partition by aoi_id order by gain desc, site_id) as r from g4) where r<=3 group by 1), h as (select aoi_id, sum(gain) as v from (select * from p1 union all select * from p2 union all select * from p3) group by 1)
 select aoi_id, round(v, 2) as value, round(v+coalesce(more,0e0), 2) as upper_bound from h left join t using (aoi_id)""", DC)
def mclp_bound(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"])
    return cover.mclp_bound(pairs, cover.greedy_p(pairs, 3), 3)


@query("lscp_backup", "with " + _cover_cte("15000", need="2e0") + " select aoi_id, site_id from final", DC, recursive=True)
def lscp_backup(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), 15000.0, ["aoi_id"], need=2.0, value=F.lit(1.0))
    return cover.drop_redundant(pairs, cover.greedy_cover(pairs))


@query("lscp_conditional", "with " + _cover_cte("10000", seed="min(site_id)") + " select aoi_id, site_id, (aoi_id, site_id) in (select aoi_id, min(site_id) from candidates group by 1) as existing from final", DC, recursive=True)
def lscp_conditional(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"], value=F.lit(1.0))
    have = _first_site(v)
    got = cover.drop_redundant(pairs, cover.greedy_cover(pairs, seed=have), keep=have)
    mark = have.select("aoi_id", "site_id", F.lit(True).alias("existing"))
    return got.join(mark, ["aoi_id", "site_id"], "left").withColumn("existing", F.coalesce("existing", F.lit(False)))


@query("lscp_probabilistic", "with " + _cover_cte("15000", need="(-ln(1e0-0.95e0))", coef="(-ln(1e0-reliability))") + " select aoi_id, site_id from final", DC, recursive=True)
def lscp_probabilistic(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), 15000.0, ["aoi_id"], need=cover.log_need(0.95), coef=cover.log_coef(), value=F.lit(1.0))
    return cover.drop_redundant(pairs, cover.greedy_cover(pairs))


@query("lscp_partial", _PARTIAL, DC, recursive=True)
def lscp_partial(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"])
    tot = v.demand().groupBy("aoi_id").agg(F.sum("weight").alias("total"))
    return cover.partial_cover(pairs, tot, 0.5)


@query("lscp_bound")
def lscp_bound(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"], value=F.lit(1.0))
    return cover.packing_bound(pairs)


@query("max_facilities", "with " + _cover_cte("10000") + " select aoi_id, count(*) as n_sites, count(*) <= 18 as within_limit from final group by 1", DC, recursive=True)
def max_facilities(v):
    """Cover with a limit on the number of sites: which areas stay within it."""
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"], value=F.lit(1.0))
    got = cover.drop_redundant(pairs, cover.greedy_cover(pairs))
    return got.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n_sites")).withColumn("within_limit", F.col("n_sites") <= 18)


def _forced_sql() -> str:
    s = _cover_sql(2)
    s = s.replace("n0 as materialized (select aoi_id, demand_id, 1e0 as need from demand)",
                  "f as (select aoi_id, min(site_id) as site_id from candidates group by 1), x as (select aoi_id, max(site_id) as site_id from candidates group by 1 having max(site_id) <> min(site_id)), "
                  "n0 as materialized (select d.aoi_id, d.demand_id, case when c.site_id is null then 1e0 else 0e0 end as need from demand d left join f using (aoi_id) left join cov c on c.aoi_id=d.aoi_id and c.demand_id=d.demand_id and c.site_id=f.site_id)")
    s = s.replace("select '' as aoi_id, -1 as site_id", "select * from f union all select * from x")
    s = s.replace("(select aoi_id, site_id from p1)", "(select aoi_id, site_id from p1 union all select * from f union all select * from x)")
    return s + " union all select aoi_id, 0, site_id, round(coalesce((select sum(weight) from cov where cov.aoi_id=f.aoi_id and cov.site_id=f.site_id), 0e0), 4) from f"


@query("forced_sites", _forced_sql(), DC)
def forced_sites(v):
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"])
    closed = v.candidates().groupBy("aoi_id").agg(F.max("site_id").alias("site_id"), F.min("site_id").alias("lo")).where("site_id <> lo")
    return cover.greedy_p(pairs, 3, must_open=_first_site(v), must_close=closed)


@query("drop_one_sensitivity", _drop_one_sql(), DC)
def drop_one_sensitivity(v):
    g = pmedian.p_median_greedy(v.demand(), v.candidates(), 2)
    return sweep.drop_one_p_median(v.demand(), v.candidates(), g, 2)


def _scenarios(v):
    """One scenario per market segment of the customers; one of them is broken."""
    s = v.table("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    r = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(0.0)).otherwise(F.length("c_mktsegment") * 1000.0)
    return s.select(F.col("c_mktsegment").alias("scenario_id"), r.alias("radius_m"))


def _sweep_sql() -> str:
    s = _cover_sql(2).replace(COV, "sc as (select distinct c_mktsegment as scenario_id, case when c_mktsegment='BUILDING' then 0e0 else length(c_mktsegment)*1000e0 end as radius_m from customer), "
                              "cov as materialized (select concat(scenario_id, '|', aoi_id) as aoi_id, demand_id, site_id, weight from od, sc where dist <= radius_m and radius_m > 0)")
    s = s.replace("select aoi_id, demand_id, 1e0 as need from demand", "select concat(scenario_id, '|', aoi_id) as aoi_id, demand_id, 1e0 as need from demand, sc where radius_m > 0")
    return ("select split_part(aoi_id,'|',1) as scenario_id, split_part(aoi_id,'|',2) as aoi_id, round(sum(gain), 2) as covered, count(*) as n_sites, null::varchar as error from ("
            + s + ") group by 1, 2 union all select distinct c_mktsegment, null, null, null, 'radius_m must be > 0' from customer where c_mktsegment='BUILDING'")


@query("parameter_sweep", _sweep_sql(), DC)
def parameter_sweep(v):
    return sweep.radius_sweep_mclp(v.demand(), v.candidates(), _scenarios(v), 2).select("scenario_id", "aoi_id", "covered", "n_sites", "error")


@query("ga_population_eval", f"""with {OD}, pop as (select aoi_id, site_id, unnest(range(4)) as ind from candidates), sel as (select * from pop where (site_id + ind) % 4 = 0 or site_id % 10 = ind),
 nn as (select s.aoi_id, s.ind, od.demand_id, any_value(weight) as weight, min(dist) as d from sel s join od using (aoi_id, site_id) group by all)
 select aoi_id, ind, n_sites, round(sum(weight*d), 0) as p_median, max(d) as p_center, round(sum(case when d <= 10000 then weight else 0e0 end), 2) as mclp, n_sites + 10*count(*) filter (d > 10000) as lscp
 from nn join (select aoi_id, ind, count(*) as n_sites from sel group by all) using (aoi_id, ind) group by aoi_id, ind, n_sites""", DC)
def ga_population_eval(v):
    c = v.candidates()
    pop = c.select("aoi_id", "site_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("ind"))
    pop = pop.where("(site_id + ind) % 4 = 0 or site_id % 10 = ind")
    return sweep.population_fitness(v.demand(), pop, c, R)


@query("ga_evolve")
def ga_evolve(v):
    return genetic.evolve_p_median(v.demand(), v.candidates(), 3, R)


@query("ga_evolve_center")
def ga_evolve_center(v):
    return genetic.evolve(v.demand(), v.candidates(), "p-center", 3, R)


@query("ga_evolve_mclp")
def ga_evolve_mclp(v):
    return genetic.evolve(v.demand(), v.candidates(), "mclp", 3, R)


@query("ga_evolve_lscp")
def ga_evolve_lscp(v):
    """Starts from the greedy cover as one of its sets."""
    pairs = cover.cover_reach(v.demand(), v.candidates(), R, ["aoi_id"])
    return genetic.evolve(v.demand(), v.candidates(), "lscp", None, R, initial=cover.greedy_cover(pairs))


@query("evaluate_solution", f"""with {OD}, s as (select *, row_number() over (partition by aoi_id order by cost, site_id) as r from candidates), nn as (select o.aoi_id, o.demand_id, o.weight, min(o.dist) as d from od o join s on s.aoi_id=o.aoi_id and s.site_id=o.site_id and s.r<=3 group by all)
 select aoi_id, round(sum(weight*d)/sum(weight), 3) as mean_m, max(d) as max_m, min(d) as min_m, round(stddev_pop(d), 2) as std_m, round(max(weight*d), 2) as max_weighted,
 round(sum(case when d<=10000 then weight else 0e0 end)/sum(weight)*100e0, 6) as pct_weight from nn group by 1""", DC)
def evaluate_solution(v):
    from ..operators.measures import top_n

    s = top_n(v.candidates(), ["aoi_id"], [F.asc("cost"), F.asc("site_id")], 3)
    n = nearest_site(v.demand(), s)
    w, d = F.col("weight"), F.col("dist_m")
    return n.groupBy("aoi_id").agg(
        F.round(F.sum(w * d) / F.sum(w), 3).alias("mean_m"), F.max(d).alias("max_m"), F.min(d).alias("min_m"), F.round(F.stddev_pop(d), 2).alias("std_m"),
        F.round(F.max(w * d), 2).alias("max_weighted"), F.round(F.coalesce(F.sum(F.when(d <= R, w)), F.lit(0.0)) / F.sum(w) * 100.0, 6).alias("pct_weight"),
    )


@query("mclp_backup", _cover_sql(3, need="2e0", gain="case when need <= 1e0+1e-9 then weight else weight/2e0 end", radius="20000"), DC)
def mclp_backup(v):
    """Backup cover is the k-cover model with k = 2 by default."""
    pairs = cover.cover_reach(v.demand(), v.candidates(), 20000.0, ["aoi_id"], need=2.0)
    return cover.greedy_p(pairs, 3, gain=cover.multi_gain(2.0))


def _batch_sql() -> str:
    s = _cover_sql(2).replace(COV, "cov as materialized (select concat(aoi_id, '|', b) as aoi_id, demand_id, site_id, weight from od, (values (0),(1)) t(b) where dist <= 10000 and demand_id%2=b)")
    s = s.replace("select aoi_id, demand_id, 1e0 as need from demand", "select concat(aoi_id, '|', demand_id%2) as aoi_id, demand_id, 1e0 as need from demand")
    return "select split_part(aoi_id,'|',1) as aoi_id, cast(split_part(aoi_id,'|',2) as bigint) as half, step, site_id, gain from (" + s + ")"


@query("batch_aoi", _batch_sql(), DC)
def batch_aoi(v):
    """Ten areas (each area's demand in two halves) solved in one keyed job."""
    d = v.demand().withColumn("half", F.col("demand_id") % 2)
    halves = d.select("aoi_id", "half").distinct()
    pairs = cover.cover_reach(d, v.candidates().join(halves, "aoi_id"), R, ["aoi_id", "half"])
    return cover.greedy_p(pairs, 2, ["aoi_id", "half"])


#: Road distances of the pairs within 20 km of each other that have a path; the rest is out of reach.
_REACH = 20000.0
ROAD_OD = f"""sn as ({SNAP.format(id="site_id", t="candidates", o="s_node", h=hav("p", "n"))}),
dn as ({SNAP.format(id="demand_id", t="demand", o="d_node", h=hav("p", "n"))}), {ROAD_PATHS},
od as materialized (select d.aoi_id, d.demand_id, s.site_id, m.weight, p.dist from dn d join sn s on s.aoi_id=d.aoi_id join demand m on m.aoi_id=d.aoi_id and m.demand_id=d.demand_id
 join path p on p.aoi_id=d.aoi_id and p.source=s.s_node and p.node=d.d_node where {hav('d', 's')} <= {_REACH})"""
ROADS = ("demand", "candidates", "road_nodes", "road_edges")


def _road_pairs(v):
    got = network.network_pairs(v.demand(), v.candidates(), v.road_nodes(), v.road_edges(), _REACH)
    return got.where("on_road").select("aoi_id", "demand_id", "site_id", "dist_m")


def _sparse_greedy_sql(p: int) -> str:
    """As the unrolled greedy rounds, with demand out of a site's reach left as it was."""
    parts = ["b0 as materialized (select aoi_id, demand_id, weight, 3e7 as d1 from demand)"]
    for i in range(1, p + 1):
        done = " union all ".join(f"select aoi_id, site_id from p{j}" for j in range(1, i)) or "select '' as aoi_id, -1 as site_id"
        parts += [
            f"t{i} as (select aoi_id, sum(weight*d1) as total from b{i-1} group by 1)",
            f"c{i} as materialized (select od.aoi_id, site_id, round(any_value(total) - sum(od.weight*(b.d1 - least(b.d1, od.dist))), 0) as cost from od join b{i-1} b using (aoi_id, demand_id) join t{i} on t{i}.aoi_id = od.aoi_id"
            f" where (od.aoi_id, site_id) not in ({done}) group by 1, 2)",
            f"p{i} as materialized (select aoi_id, arg_min(site_id, (cost, site_id)) as site_id, min(cost) as cost from c{i} group by 1)",
            f"b{i} as materialized (select b.aoi_id, b.demand_id, b.weight, least(b.d1, coalesce(od.dist, b.d1)) as d1 from b{i-1} b left join p{i} q using (aoi_id)"
            f" left join od on od.aoi_id=b.aoi_id and od.demand_id=b.demand_id and od.site_id=q.site_id)",
        ]
    return ", ".join(parts) + " " + " union all ".join(f"select aoi_id, {i} as step, site_id, cost from p{i}" for i in range(1, p + 1))


@query("p_median_network", f"with {ROAD_OD}, {_sparse_greedy_sql(3)}", ROADS, recursive=True)
def p_median_network(v):
    """p-median on road distances."""
    return relation.p_median_on_pairs(_road_pairs(v), v.demand(), 3)[0]


def _cover_network_sql() -> str:
    sql = _cover_sql(3)
    return f"with {ROAD_OD}" + sql[len("with ") + len(OD):].replace("dist <= 10000", "dist <= 15000")


@query("mclp_network", _cover_network_sql(), ROADS, recursive=True)
def mclp_network(v):
    """Most demand within 15 km by road of three sites."""
    near = network.covered_by_road(v.demand(), v.candidates(), v.road_nodes(), v.road_edges(), _REACH, 15000.0)
    return cover.greedy_p(cover.pairs_of_relation(near, ["aoi_id"]), 3)
