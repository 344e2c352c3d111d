"""Text jobs over the conversations; phrases derived from ids are added to the given texts."""

from pyspark.sql import functions as F

from ..plans import messages
from .registry import query

_N = "cast(1+(conv_id*5+turn*3)%40 as string)"
_P = "(conv_id*7+turn)%14"
_MSG = (f"case {_P} when 11 then concat('  Yes, proceed. ', text) else concat(text, case {_P} when 0 then concat(' Please place ', {_N}, ' facilities within ', {_N}, '.5 km.') when 1 then concat(' n_facilities = ', {_N}) "
        f"when 2 then concat(' Use the budget variant with a budget of ', {_N}, ' and locate ', {_N}, ' stations') when 3 then ' k = 2' when 4 then concat(' capacity of ', {_N}) when 5 then concat(' maximum travel distance: ', {_N}) "
        f"when 6 then concat(' weights are from 1 to ', {_N}) when 7 then concat(' radius of ', {_N}) when 8 then ' at least 3 sites, capacity constraint' when 9 then concat(' sr = ', {_N}, ' nautical miles') "
        "when 10 then ' Minimize maximum distance for fairness, a p-center' when 12 then ' Maximize coverage in the service area' when 13 then ' set cover with the minimum number' else '' end) end")
_KEYS = ["conv_id", "turn"]


def _messages(v):
    return v.table("conversations").select("conv_id", "turn", F.expr(_MSG).alias("text"))


def _first(patterns, group=1):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', {group}), '')" for p in patterns) + ")"


def _has(phrases):
    return "(" + " or ".join(f"contains(t, '{p}')" for p in phrases) + ")"


_RU = "case " + " ".join(f"when regexp_extract(t, '{p}', 1)<>'' then struct_pack(v := regexp_extract(t, '{p}', 1), u := regexp_replace(regexp_extract(t, '{p}', 2), '\\s+', '', 'g'))" for p in messages.RADIUS_PATTERNS) + " end"
_FAC = ("case when r.u in ('km','kilometer','kilometers') then 1000e0 when r.u in ('mi','mile','miles') then 1609.344e0 when r.u in ('ft','feet','foot') then 0.3048e0 when r.u in ('yd','yard','yards') then 0.9144e0 "
        "when r.u in ('nm','nmi','nauticalmile','nauticalmiles') then 1852e0 else 1e0 end")
_BARE = _first([p.replace(messages.BARE, r"(\d+(?:\.\d*)?)(?:\s*$|\s*[^a-z0-9.\s])") for p in messages.BARE_RADIUS_PATTERNS])
_VAR = "case " + " ".join(f"when {_has(ph)} then '{n}'" for n, ph in messages.VARIANT_PHRASES) + " end"
_RNG = r"weights?\s+(?:are\s+)?(?:from\s+)?([\d.]+)\s+to\s+([\d.]+)"


@query("extract_slots", f"""with m as (select conv_id, turn, lower({_MSG}) as t from conversations), x as (select *, {_RU} as r, {_BARE} as bare, {_VAR} as variant from m)
 select conv_id, turn, try_cast({_first(messages.COUNT_PATTERNS)} as bigint) as n_facilities, case when r is not null then try_cast(r.v as double)*{_FAC} else try_cast(bare as double) end as radius_m, r is null and bare is not null as radius_unit_missing, variant,
 case when {_has(("budget variant", "budget constraint", "budget problem", "budget optimization", "with budget", "budget limit", "cost constraint"))} and variant='budget' then try_cast({_first(messages.BUDGET_PATTERNS)} as double) end as budget,
 try_cast(coalesce(nullif(regexp_extract(t, 'k\\s*=?\\s*(\\d+)', 1), ''), nullif(regexp_extract(t, 'at\\s+least\\s+(\\d+)\\s+(facilities|sites|centers?)', 1), '')) as bigint) as k_coverage,
 try_cast(nullif(regexp_extract(t, 'capacity\\s*(of|=)?\\s*(\\d+\\.?\\d*)', 2), '') as double) as capacity, try_cast({_first(messages.MAX_DISTANCE_PATTERNS)} as double) as max_distance,
 try_cast(nullif(regexp_extract(t, '{_RNG}', 1), '') as double) as weight_lo, try_cast(nullif(regexp_extract(t, '{_RNG}', 2), '') as double) as weight_hi from x""")
def extract_slots(v):
    return messages.extract_slots(_messages(v))


def _score(m):
    return " + ".join([f"case when contains(t, '{w}') then 2 else 0 end" for w in m[4]] + [f"case when contains(t, '{m[1].lower()}') then 5 else 0 end", f"case when contains(t, '{m[0]}') then 5 else 0 end"])


@query("infer_problem_type", f"""with m as (select conv_id, turn, lower({_MSG}) as t from conversations), s as (select conv_id, turn, unnest([{', '.join(f"struct_pack(o := {i}, model := '{m[0]}', score := {_score(m)})" for i, m in enumerate(messages.MODELS))}]) as s from m)
 select conv_id, turn, case when max(s.score)>0 then arg_min(s.model, (-s.score, s.o)) end as model, max(s.score) as score from s group by 1,2""")
def infer_problem_type(v):
    return messages.infer_problem_type(_messages(v))


@query("is_affirmative", f"select conv_id, turn, regexp_matches(lower(trim({_MSG})), '^({'|'.join(messages.AFFIRMATIVES)})') as yes from conversations")
def is_affirmative(v):
    return _messages(v).select("conv_id", "turn", messages.is_affirmative(F.col("text")).alias("yes"))


_MODEL_TEXTS = ", ".join("('%s', '%s')" % (s, " ".join((n, d, *w, *u)).lower()) for s, n, _, d, w, u in messages.MODELS)


@query("search_problems", f"""with m(s, t) as (values {_MODEL_TEXTS}), w as (select conv_id, turn, list_distinct(regexp_extract_all(lower({_MSG}), '{messages.TERM}')) as w from conversations),
 h as (select conv_id, turn, s, count(*) as n from (select conv_id, turn, unnest(w) as one from w) join m on contains(t, one) group by all)
 select conv_id, turn, cast(len(w) as bigint) as terms, coalesce((select string_agg(concat(s, ':', n), ',' order by n desc, s) from h where h.conv_id=w.conv_id and h.turn=w.turn), '') as models from w""")
def search_problems(v):
    return messages.models_of_messages(_messages(v))


_TOOL = "case (conv_id+turn)%5 when 1 then 'confirm_optimization' when 2 then 'run_sensitivity_analysis' when 4 then 'fetch' end"


@query("narratives_for_solution", f"""with s as (select conv_id, turn, trim(text) as text, case when conv_id%3<>0 or (conv_id+turn)%5<>1 then {_TOOL} end as tool from conversations where role='assistant'),
 a as (select conv_id, max(turn) filter (tool='confirm_optimization') as st, max(turn) filter (text<>'') as la from s group by 1)
 select s.conv_id, turn, text from s join a using (conv_id) where text<>'' and ((st is not null and turn>=st and (turn=st or coalesce(tool in ('confirm_optimization','run_sensitivity_analysis','analyze_existing_facilities'), false))) or (st is null and turn=la))""")
def narratives_for_solution(v):
    tool = F.expr(f"case when conv_id%3<>0 or (conv_id+turn)%5<>1 then {_TOOL} end")
    return messages.narratives(v.table("conversations").withColumn("tool", tool))
