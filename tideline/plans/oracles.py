"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .adapters import TURN_SECONDS, WEEK
from .catalog import BUDGET, DELTA, DRAWS, GAP, SCREEN_DRAWS, SWEEP

EV = f"""ev as (select user_id as rec_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, epoch_us(ts) / 1e6 as t, event_id, event_type, value from events),
turns as (select rec_id, t as start, least(t + {TURN_SECONDS}, lead(t) over (partition by rec_id order by t, event_id)) as "end", (event_id % 3)::int as speaker from ev where event_type = 'signup'),
toks as (select rec_id, floor(t / {WEEK})::int as sent_ix, i as pos, t from ev where event_type <> 'signup')"""
FR = """fr as (select label as rec_id, row_number() over (partition by label order by vec_id) - 1 as frame_ix,
  list_transform(embedding, lambda x: least(255, greatest(0, floor((x::double + 1) * 127.5)::int))) as tiles from embeddings),
pr as (select rec_id, frame_ix, tiles, lag(tiles) over w as before, lead(tiles) over w as after from fr window w as (partition by rec_id order by frame_ix))"""


def diff(a: str, b: str, test: str = ">") -> str:
    return f"len(list_filter(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]) {test} {DELTA}))"


SC = FR + f", sc as (select rec_id, frame_ix - 1 as i, {diff('before', 'tiles')} as score from pr where before is not null)"
ES = EV + ", sc as (select rec_id, i, trunc(value)::int as score from ev)"


def marks(budget: str = str(BUDGET), gap: float = GAP, join: str = "") -> str:
    """Common tables up to mk (rec_id, t, score, look) over sc; a recursion over the rank carries what has been taken."""
    return f"""
n as (select rec_id, count(*) as n from sc group by 1),
rk as (select sc.rec_id, i, score, {budget} as budget, row_number() over (partition by sc.rec_id order by score desc, i) as k from sc {join} where score > 0),
pick as (select rec_id, 0::bigint as k, []::bigint[] as got from n
  union all select p.rec_id, p.k + 1, case when len(p.got) < rk.budget and len(list_filter(p.got, lambda g: not (abs(g - rk.i)::double * (1.0::double) >= {gap}))) = 0 then list_append(p.got, rk.i) else p.got end
  from pick p join rk on rk.rec_id = p.rec_id and rk.k = p.k + 1),
fin as (select rec_id, unnest(arg_max(got, k)) as i from pick group by 1),
mk as (select rec_id, t, score, (t + e) / 2 as look from (select f.rec_id, f.i + 1.0::double as t, s.score, coalesce(lead(f.i + 1.0::double) over (partition by f.rec_id order by f.i), n.n::double) as e
  from fin f join sc s on s.rec_id = f.rec_id and s.i = f.i join n on n.rec_id = f.rec_id))"""


EM = f"with recursive {ES}, {marks()}"
FM = f"with recursive {SC}, {marks()}"
ASOF = """ao as (select p.*, t.start as ps, t."end" as pe, t.speaker as psp from toks p asof left join turns t on p.rec_id = t.rec_id and p.t >= t.start),
nx as (select a.*, u.start as ns, u.speaker as nsp from ao a asof left join turns u on a.rec_id = u.rec_id and a.t < u.start),
lab as (select *, case when t <= pe then psp end as speaker, case when ps is null then nsp when ns is null or greatest(0.0, t - pe) <= ns - t then psp else nsp end as nearest from nx)"""
VOTE = f"""with {EV}, {ASOF},
v as (select rec_id, sent_ix, speaker, count(*) as votes, arg_min(t, pos) as first_t from lab where speaker is not null group by all),
won as (select * from (select *, row_number() over (partition by rec_id, sent_ix order by votes desc, first_t) as k from v) where k = 1),
st as (select rec_id, sent_ix, arg_min(nearest, pos) as nearest, count(*) as n from lab group by all),
sl as (select st.rec_id, st.sent_ix, coalesce(won.speaker, st.nearest) as speaker, st.n from st left join won using (rec_id, sent_ix))"""
OVER = """ss as (select rec_id, sent_ix, arg_min(t, pos) as start, arg_max(t, pos) as "end", arg_min(nearest, pos) as nearest from lab group by all),
ov as (select ss.rec_id, ss.sent_ix, arg_min(t.speaker, row(-(least(ss."end", t."end") - greatest(ss.start, t.start)), t.start, t."end", t.speaker)) as speaker
  from ss join turns t on ss.rec_id = t.rec_id and ss.start < t."end" and t.start < ss."end" group by all),
ol as (select ss.rec_id, ss.sent_ix, coalesce(ov.speaker, ss.nearest) as speaker from ss left join ov using (rec_id, sent_ix))"""
SL = """sd as (select rec_id, i::double as time, case event_type when 'error' then -1 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 when 'view' then 4 end::int as slide from ev),
cp as (select rec_id, time, lower_bound, from_slide, to_slide, case when from_slide = -1 or to_slide = -1 then 'view_cut' else 'slide_flip' end as kind from
  (select rec_id, time, lag(time) over w as lower_bound, lag(slide) over w as from_slide, slide as to_slide from sd window w as (partition by rec_id order by time)) where from_slide <> to_slide)"""
PU = "pu as (select rec_id, i::double as t from ev where event_type = 'purchase')"
HASH = """hs as (select rec_id, frame_ix, list_reduce(list_prepend(0::bigint, list_transform(list_filter(range(1, 65), lambda k: k % 8 <> 0), lambda k: (tiles[k] > tiles[k + 1])::bigint)), lambda a, x: a * 2 + x) as h from fr)"""
ID = "id as (select m.rec_id, c.lower_bound as lo, c.time as hi, min(case when m.t between c.lower_bound and c.time then 0.0 else least(abs(m.t - c.lower_bound), abs(m.t - c.time)) end) as distance from cp c join mk m on m.rec_id = c.rec_id group by all)"
INST = f"ins as (select rec_id, frame_ix as second, round(({diff('tiles', 'before')}::double / len(tiles) + {diff('tiles', 'after')}::double / len(tiles)) / 2, 9) as instability from pr where before is not null and after is not null)"
NORM = "lower(trim(regexp_replace(regexp_replace(text, '[*|#`]', ' ', 'g'), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')))"
HITS = f"t as (select doc_id, {NORM} as body from documents), i as (select item_id, {NORM} as want from benchmark), hit as (select item_id, doc_id from t join i on want <> '' and contains(body, want))"
DEI = r"""cand as (select doc_id, sent_ix, sentence, pointers from (select doc_id, sent_ix, sentence, len(regexp_extract_all(lower(sentence), '\b(this|here|that|these|there)\b')) as pointers from
  (select doc_id, generate_subscripts(p, 1) - 1 as sent_ix, trim(unnest(p)) as sentence from (select doc_id, regexp_split_to_array(text, '[.!?\n]') as p from documents)))
  where pointers >= 2 and length(sentence) between 40 and 200)"""
CLOCK = lambda x: f"case when {x} is null then '--:--' when trunc({x})::bigint >= 3600 then printf('%d:%02d:%02d', trunc({x})::bigint // 3600, (trunc({x})::bigint % 3600) // 60, trunc({x})::bigint % 60) else printf('%d:%02d', trunc({x})::bigint // 60, trunc({x})::bigint % 60) end"

GEO = "with g as (select doc_id as rec_id, n_chars as total, unnest(range(0, n_chars, 1050)) as start from documents where n_chars > 0), geo as (select rec_id, (row_number() over (partition by rec_id order by start) - 1)::int as chunk_ix, start, least(start + 1200, total) as \"end\" from g qualify least(start + 1200, total) - start >= 16)"
COVER = f"""nn as (select rec_id, max(frame_ix) as n from fr group by 1), sec as (select fr.rec_id, frame_ix, tiles, n from fr join nn using (rec_id) where frame_ix between 1 and n - 1),
seg as (select s.*, coalesce(m.look, f.look) as look from sec s asof left join mk m on s.rec_id = m.rec_id and s.frame_ix >= m.t left join (select rec_id, arg_min(look, t) as look from mk group by 1) f on f.rec_id = s.rec_id),
cover as (select seg.rec_id, round(avg(1 - {diff('fr.tiles', 'seg.tiles')}::double / len(seg.tiles)), 9) as coverage from seg join fr on fr.rec_id = seg.rec_id and fr.frame_ix = least(trunc(look)::int, n) group by 1)"""
SCREENS = f"""nm as (select rec_id, count(*) as n from mk group by 1),
ds as (select ins.rec_id, second, instability, n, draw, ('0x' || substr(md5(concat_ws('|', '0', ins.rec_id, draw, second)), 1, 8))::bigint / 4294967296.0::double as u from ins join nm using (rec_id), range({SCREEN_DRAWS}) x(draw)),
dr as (select * from (select *, row_number() over (partition by rec_id, draw order by u, second) as k from ds) where k <= n),
dseg as (select p.rec_id, p.draw, p.second, coalesce(d.second, f.second) as shown from ds p asof left join dr d on p.rec_id = d.rec_id and p.draw = d.draw and p.second >= d.second join (select rec_id, draw, min(second) as second from dr group by all) f on f.rec_id = p.rec_id and f.draw = p.draw),
dcov as (select g.rec_id, g.draw, round(avg(1 - {diff('a.tiles', 'b.tiles')}::double / len(a.tiles)), 9) as coverage from dseg g join fr a on a.rec_id = g.rec_id and a.frame_ix = g.shown join fr b on b.rec_id = g.rec_id and b.frame_ix = g.second group by all),
screens as (select rec_id, draw, round(avg(instability), 9) as instability, any_value(coverage) as coverage from dr join dcov using (rec_id, draw) group by rec_id, draw)"""


def coarse(factor: int, width: int = 8, to: str = "co") -> str:
    n = width // factor
    return f"""{to}_c as (select rec_id, frame_ix, ((k // {width}) // {factor}) * {n} + (k % {width}) // {factor} as b, v from (select rec_id, frame_ix, unnest(range(len(tiles))) as k, unnest(tiles) as v from fr) where (k // {width}) // {factor} < {n} and (k % {width}) // {factor} < {n}),
{to}_b as (select rec_id, frame_ix, b, floor(avg(v))::int as v from {to}_c group by all), {to} as (select rec_id, frame_ix, list(v order by b) as tiles from {to}_b group by all),
{to}_pr as (select rec_id, frame_ix, tiles, lag(tiles) over (partition by rec_id order by frame_ix) as before from {to})"""


def regions(pairs: str, width: int, delta: int, out: str = "", tag: str = "") -> str:
    """Common tables up to sz (rec_id, i, size): the largest 4-connected region of changed tiles, by reachability. out: a
    table (rec_id, k) of tiles that are left out."""
    left = f"where not exists (select 1 from {out} o where o.rec_id = c.rec_id and o.k = c.k)" if out else ""
    return f"""each{tag} as (select rec_id, frame_ix - 1 as i, unnest(range(len(tiles))) as k, unnest(list_transform(list_zip(before, tiles), lambda z: abs(z[1] - z[2]) > {delta})) as c from {pairs} where before is not null),
ce{tag} as (select rec_id, i, k from each{tag} c {left + (' and' if left else 'where')} c),
re{tag}(rec_id, i, k, x) as (select rec_id, i, k, k from ce{tag} union select r.rec_id, r.i, r.k, n.k from re{tag} r join ce{tag} n on n.rec_id = r.rec_id and n.i = r.i and (abs(n.k - r.x) = {width} or abs(n.k - r.x) = 1 and n.k // {width} = r.x // {width})),
sz{tag} as (select p.rec_id, p.i, coalesce(max(n), 0) as size from (select distinct rec_id, i from each{tag}) p left join (select rec_id, i, k, count(*) as n from re{tag} group by all) q on q.rec_id = p.rec_id and q.i = p.i group by all)"""


def masked_regions(pairs: str, width: int, delta: int, most: float, cap: float, tag: str = "") -> str:
    return f"""ac{tag} as (select rec_id, k, avg(c::int) as activity from (select rec_id, unnest(range(len(tiles))) as k, unnest(list_transform(list_zip(before, tiles), lambda z: abs(z[1] - z[2]) > {delta})) as c from {pairs} where before is not null) group by all),
ok{tag} as (select rec_id from ac{tag} group by 1 having avg((activity >= {most}::double)::int) <= {cap}::double), ma{tag} as (select rec_id, k from ac{tag} where activity >= {most}::double and rec_id in (select rec_id from ok{tag})),
{regions(pairs, width, delta, f'ma{tag}', tag)}"""


def sweep_sql() -> str:
    parts, rows, n = [], [], 0
    for factor in SWEEP["factors"]:
        if factor > 1:
            parts.append(coarse(factor, 8, f"g{factor}"))
        for delta in SWEEP["deltas"]:
            for most in SWEEP["masks"]:
                tag = f"_{n}"
                parts.append(masked_regions("pr" if factor == 1 else f"g{factor}_pr", 8 // factor, delta, most, 0.25, tag))
                for least in SWEEP["sizes"]:
                    rows.append(f"select {n} as config_ix, {factor} as factor, {delta} as delta, {most}::double as most, {least} as least, rec_id, count(*) filter (where size >= {least}) as n_marks from sz{tag} group by rec_id")
                    n += 1
    return f"with recursive {FR}, {', '.join(parts)}, every_config as ({' union all '.join(rows)})"


SQL: dict[str, str] = {
    "change_scores": f"with {SC} select rec_id, i::int as i, score::int as score from sc",
    "change_marks": f"{FM} select * from mk",
    "marks_events": f"{EM} select * from mk",
    "change_marks_budget_matched": f"with recursive {ES}, b as (select rec_id, count(*) filter (where event_type = 'purchase') as b from ev group by 1), {marks('b.b', 0.0, 'join b on b.rec_id = sc.rec_id')} select * from mk",
    "mark_gaps": f"{EM}, g as (select rec_id, lead(t) over (partition by rec_id order by t) - t as gap from mk) select rec_id, count(*) as n_gaps, round(quantile_cont(gap, 0.5), 6) as median_gap, round(quantile_cont(gap, 0.9), 6) as p90_gap, max(gap) as max_gap from g where gap is not null group by 1",
    "mark_bucket_counts": f"{EM} select rec_id, floor(t / 20.0)::bigint as bucket, count(*) as n_marks from mk group by all",
    "score_percentiles": f"with {ES} select rec_id, round(quantile_cont(score, 0.5), 6) as median, round(quantile_cont(score, 0.9), 6) as p90, round(quantile_cont(score, 0.99), 6) as p99, max(score) as highest, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std from sc group by 1",
    "asof_speaker": f"with {EV}, {ASOF} select rec_id, pos, t, speaker from lab",
    "nearest_speaker": f"with {EV}, {ASOF} select rec_id, pos, t, nearest from lab",
    "speaker_vote": f"{VOTE} select rec_id, sent_ix, speaker from sl",
    "vote_census": f"with {EV}, {ASOF}, x as (select rec_id, sent_ix, count(distinct speaker) as k, count(*) filter (where speaker is null) as gap from lab group by all) select rec_id, count(*) as sentences, count(*) filter (where k = 1) as unanimous, count(*) filter (where k > 1) as straddling, count(*) filter (where k = 0) as all_in_gap, sum(gap)::bigint as gap_tokens from x group by 1",
    "vote_margins": f"{VOTE}, r as (select *, row_number() over (partition by rec_id, sent_ix order by votes desc) as k, sum(votes) over (partition by rec_id, sent_ix) as n from v), m as (select rec_id, (max(votes) filter (where k = 1) - max(votes) filter (where k = 2))::double / any_value(n)::double as margin from r group by rec_id, sent_ix having count(*) > 1) select rec_id, count(*) as straddling, round(list_sort(list(margin))[1], 9) as least_margin, round(list_sort(list(margin))[count(*) // 2 + 1], 9) as median_margin from m group by 1",
    "speaker_wins": f"{VOTE}, w as (select rec_id, speaker, count(*) as sentences, sum(n)::bigint as words from sl group by all) select e.rec_id, e.speaker, coalesce(w.sentences, 0) as sentences, coalesce(w.words, 0)::bigint as words from (select distinct rec_id, speaker from turns) e left join w using (rec_id, speaker)",
    "speaker_totals": f"with {EV} select rec_id, speaker, round(sum(\"end\" - start), 3) as seconds from turns group by all",
    "speaker_runs": f"{VOTE}, r as (select rec_id, speaker is distinct from lag(speaker) over (partition by rec_id order by sent_ix) as new from sl) select rec_id, greatest(1, count(*) filter (where new))::bigint as runs from r group by 1",
    "label_encode": "select rec_id, label, (row_number() over (partition by rec_id order by label) - 1)::int as ix from (select distinct conv_id as rec_id, role as label from conversations)",
    "overlap_label": f"with {EV}, {ASOF}, {OVER} select * from ol",
    "vote_overlap_disagreement": f"{VOTE}, {OVER} select rec_id, count(*) as sentences, count(*) filter (where sl.speaker is distinct from ol.speaker) as different from sl full join ol using (rec_id, sent_ix) group by 1",
    "turn_overlap_violations": f"with {EV}, x as (select rec_id, start, start + {TURN_SECONDS} as e, speaker from turns) select rec_id, start, e as \"end\", speaker from (select *, lag(e) over (partition by rec_id order by start, e, speaker) as b from x) where start < b",
    "chunk_geometry": "with g as (select doc_id as rec_id, n_chars as total, unnest(range(0, n_chars, 1050)) as start from documents where n_chars > 0), h as (select *, (row_number() over (partition by rec_id order by start) - 1)::int as chunk_ix, coalesce(lead(start) over (partition by rec_id order by start), total) as next_start, least(start + 1200, total) as \"end\" from g) select rec_id, chunk_ix, start, \"end\", next_start from h where \"end\" - start >= 16",
    "chunks_remaining": f"{GEO} select rec_id, chunk_ix, start from geo where start >= 1050",
    "chunks_reported": f"{GEO} select rec_id, chunk_ix, \"end\" / 10.0 as done_s, max(\"end\") over (partition by rec_id) / 10.0 as total_s from geo",
    "token_shift": f"with {EV}, x as (select rec_id, i, unnest(range(greatest(0, ceil((i - 11) / 8.0)::bigint), i // 8 + 1)) as chunk_ix from ev) select rec_id, chunk_ix::bigint as chunk_ix, i::int as pos, i::double as start from x",
    "sentence_segments": r"""with c as (select conv_id as rec_id, turn, string_split(text, ' ') as p from conversations),
w as (select rec_id, turn, generate_subscripts(p, 1) as k, ' ' || unnest(p) as text from c),
n as (select *, row_number() over (partition by rec_id order by turn, k) - 1 as pos from w),
z as (select *, coalesce(sum(regexp_matches(text, '[.!?][ \t\n\x0b\x0c\r]*$')::int) over (partition by rec_id order by pos rows between unbounded preceding and 1 preceding), 0)::int as sent_ix from n)
select rec_id, sent_ix, round(min(pos) * 0.4::double, 6) as start, round(max(pos) * 0.4::double + 0.4::double, 6) as "end", string_agg(text, '' order by pos) as text, count(*)::int as n_tokens from z group by 1, 2""",
    "changepoints": f"with {EV}, {SL} select * from cp",
    "changepoint_summary": f"with {EV}, {SL}, c as (select rec_id, count(*) as changes from cp group by 1) select sd.rec_id, count(*) as sentences, max(time) as duration, count(distinct slide) as slides, coalesce(any_value(changes), 0) as changes from sd left join c using (rec_id) group by 1",
    "changepoint_corpus": f"with {EV}, {SL}, du as (select rec_id, max(time) as duration from sd group by 1), per as (select kind, rec_id, count(*) as n, any_value(duration) as duration from cp join du using (rec_id) group by all) select kind, count(*) as recordings, sum(n)::bigint as changes, round(sum(duration) / 3600.0, 6) as hours from per group by 1 union all select 'all', (select count(*) from du), (select count(*) from cp), (select round(sum(duration) / 3600.0, 6) from du)",
    "nearest_distance": f"{EM}, {PU} select pu.rec_id, pu.t, min(abs(pu.t - mk.t)) as distance from pu join mk on pu.rec_id = mk.rec_id group by all",
    "interval_distance": f"{EM}, {SL}, {ID} select * from id",
    "interval_hits": f"{EM}, {SL}, {ID} select rec_id, count(*) as n, round(avg(distance), 6) as mean_distance, round(avg((distance <= 2.0)::int), 6) as hit_rate from id group by 1",
    "segment_coverage": f"""{FM}, nn as (select rec_id, max(frame_ix) as n from fr group by 1), sec as (select fr.rec_id, frame_ix, tiles, n from fr join nn using (rec_id) where frame_ix between 1 and n - 1),
 seg as (select s.*, coalesce(m.look, f.look) as look from sec s asof left join mk m on s.rec_id = m.rec_id and s.frame_ix >= m.t left join (select rec_id, arg_min(look, t) as look from mk group by 1) f on f.rec_id = s.rec_id)
 select seg.rec_id, round(avg(1 - {diff('fr.tiles', 'seg.tiles')}::double / len(seg.tiles)), 9) as coverage from seg join fr on fr.rec_id = seg.rec_id and fr.frame_ix = least(trunc(look)::int, n) group by 1""",
    "frame_instability": f"with {FR}, {INST} select * from ins",
    "unstable_marks": f"{FM}, {INST}, lim as (select rec_id, round(quantile_cont(instability, 0.95), 9) as lim, min(second) as lo, max(second) as hi from ins group by 1) select mk.rec_id, count(*) as marks, count(*) filter (where instability >= lim) as unstable from mk join lim on lim.rec_id = mk.rec_id join ins on ins.rec_id = mk.rec_id and ins.second = greatest(lo, least(hi, trunc(mk.t)::int)) group by 1",
    "preceding_mark_age": f"{EM}, {PU} select p.rec_id, p.t, p.t - m.t as age from (select pu.* from pu semi join mk using (rec_id)) p asof left join mk m on p.rec_id = m.rec_id and p.t >= m.t",
    "noise_floor": f"with {SC} select rec_id, round(quantile_cont(score, 0.5), 6) as median_score from sc group by 1",
    "random_baseline": f"with {EV}, {PU}, n as (select rec_id, count(*)::double as duration from ev group by 1), m as (select rec_id, d, ('0x' || substr(md5(concat_ws('|', '0', rec_id, d, k)), 1, 8))::bigint / 4294967296.0::double * duration as t from n, range({DRAWS}) x(d), range({BUDGET}) y(k)), z as (select pu.rec_id, pu.t, m.d, min(abs(pu.t - m.t)) as distance from pu join m on pu.rec_id = m.rec_id group by all) select rec_id, round(avg(distance), 4) as mean_distance from z group by 1",
    "random_distance_p": f"{EM}, {PU}, sn as (select rec_id, count(*)::double as duration from ev group by 1), m as (select rec_id, d, ('0x' || substr(md5(concat_ws('|', '0', rec_id, d, k)), 1, 8))::bigint / 4294967296.0::double * duration as t from sn, range({DRAWS}) x(d), range({BUDGET}) y(k)), z as (select pu.rec_id, pu.t, m.d, min(abs(pu.t - m.t)) as distance from pu join m on pu.rec_id = m.rec_id group by all), r as (select rec_id, d, round(avg(distance), 6) as mean from z group by all), o as (select rec_id, round(avg(distance), 6) as ours from (select pu.rec_id, pu.t, min(abs(pu.t - mk.t)) as distance from pu join mk on pu.rec_id = mk.rec_id group by all) group by 1) select rec_id, ours, count(*) as draws, count(*) filter (where mean <= ours) as closer, round((count(*) filter (where mean <= ours))::double / count(*), 6) as p from o join r using (rec_id) group by all",
    "random_screens": f"{FM}, {INST}, {SCREENS} select rec_id, draw::int as draw, instability, coverage from screens",
    "coverage_sigma": f"""{FM}, {INST}, {SCREENS}, {COVER}, r as (select rec_id, avg(coverage) as m, stddev_pop(coverage) as s from screens group by 1)
 select rec_id, coverage as ours, round(m, 6) as random_mean, round(s, 6) as random_std, round(case when s > 0 then (coverage - m) / s end, 4) as sigma from cover join r using (rec_id)""",
    "usable_truth": f"with {EV}, {PU}, sp as (select rec_id, count(*) as n from ev group by 1), x as (select pu.rec_id, pu.t * 2 as t from pu join sp using (rec_id) where n >= 8 and pu.t * 2 <= n) select * from x where rec_id in (select rec_id from x group by 1 having count(*) >= 2)",
    "usable_intervals": f"{EM}, {SL}, x as (select rec_id, lower_bound as lo, time as hi from cp) select * from x where rec_id in (select rec_id from x group by 1 having count(*) >= 5) and rec_id in (select rec_id from mk)",
    "sign_test": """with w as (select count(*) as n, count(*) filter (where toxic < quality) as wins, count(*) filter (where toxic > quality) as losses, count(*) filter (where toxic = quality) as ties, round(avg(toxic), 6) as mean_ours, round(avg(quality), 6) as mean_theirs from labels)
select w.*, (select round(coalesce(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0))), 1.0), 9) from range(w.n + 1) x(k) where k >= w.wins) as p from w""",
    "recall_pairs": f"with {HITS} select * from hit",
    "recall_misses": f"with {HITS} select item_id from benchmark where item_id not in (select item_id from hit)",
    "recall_by_item": f"with {HITS}, g as (select item_id, item_id % 5 as grp, item_id in (select item_id from hit) as h from benchmark) select grp::varchar as grp, count(*) filter (where h) as hits, count(*) as total, round((count(*) filter (where h))::double / count(*), 6) as recall from g group by rollup(grp)",
    "deictic_candidates": f"with {DEI} select doc_id, sent_ix, sentence, pointers from cand",
    "deictic_densest_bucket": f"with {DEI} select doc_id, bucket, sent_ix, pointers from (select *, row_number() over (partition by doc_id, bucket order by pointers desc, sent_ix) as k from (select *, floor(sent_ix * 4.0 / 180.0)::bigint as bucket from cand)) where k = 1",
    "hash_consecutive": f"with {FR}, {HASH}, x as (select rec_id, frame_ix, bit_count(xor(h, lag(h) over (partition by rec_id order by frame_ix))) as distance from hs) select * from x where distance is not null",
    "hash_summary": f"with {FR}, {HASH}, x as (select rec_id, bit_count(xor(h, lag(h) over (partition by rec_id order by frame_ix))) as distance from hs) select rec_id, round(avg(distance), 6) as mean, round(quantile_cont(distance, 0.5), 6) as p50, round(quantile_cont(distance, 0.75), 6) as p75, round(quantile_cont(distance, 0.9), 6) as p90, round(quantile_cont(distance, 0.99), 6) as p99, max(distance) as highest, count(*) filter (where distance = 0) as identical from x where distance is not null group by 1",
    "hash_keep_last": f"with recursive {FR}, {HASH}, k(rec_id, frame_ix, h, kept) as (select rec_id, frame_ix, h, true from hs where frame_ix = 0 union all select k.rec_id, hs.frame_ix, case when bit_count(xor(hs.h, k.h)) > 26 then hs.h else k.h end, bit_count(xor(hs.h, k.h)) > 26 from k join hs on hs.rec_id = k.rec_id and hs.frame_ix = k.frame_ix + 1) select rec_id, frame_ix from k where kept",
    "tile_activity": f"with {FR}, x as (select rec_id, unnest(range(64)) as tile_ix, unnest(list_transform(list_zip(before, tiles), lambda z: (abs(z[1] - z[2]) > {DELTA})::int)) as c from pr where before is not null) select rec_id, tile_ix, round(avg(c), 9) as activity from x group by all",
    "row_activity": f"with {FR}, x as (select rec_id, unnest(range(64)) as tile_ix, unnest(list_transform(list_zip(before, tiles), lambda z: (abs(z[1] - z[2]) > {DELTA})::int)) as c from pr where before is not null), a as (select rec_id, tile_ix, round(avg(c), 9) as activity from x group by all) select rec_id, (tile_ix // 8)::int as row_ix, round(avg(activity), 6) as activity from a group by all",
    "coarse_frames": f"with {FR}, {coarse(3)} select rec_id, frame_ix, list_aggregate(tiles, 'string_agg', ',') as tiles from co",
    "component_size": f"with recursive {FR}, {regions('pr', 8, DELTA)} select rec_id, i::int as i, size::int as size from sz",
    "region_marks": f"with recursive {FR}, {masked_regions('pr', 8, DELTA, 0.5, 1.0)} select rec_id, (i + 1)::int as frame_ix from sz where size >= 8",
    "sweep_marks": f"{sweep_sql()} select * from every_config",
    "best_config": f"{sweep_sql()}, c as (select config_ix, sum(n_marks)::bigint as n_marks, min(n_marks) > 0 as hit from every_config group by 1) select config_ix, n_marks from c where hit order by n_marks, config_ix limit 1",
    "stitch_overlap": f"with {EV} select rec_id, i::int as pos, event_id::int as id, ' ' || event_type as text, i::double as start, 0.5::double as duration, 1.0::double as confidence from ev",
    "stitch_stateful": f"with {EV} select rec_id, i::int as pos, event_id::int as id, ' ' || event_type as text, i::double as start, 0.5::double as duration, 1.0::double as confidence from ev",
    "progress_bar": f"""with p as (select event_id, value, greatest(0.0, value / 4427.028) as f, case when event_id / 100.0 > 0 then (value - 2.0) / (event_id / 100.0) else 0.0 end as v from events)
select event_id, printf('%10s [%s%s] %3.0f%%  %s/%s audio  elapsed %s  eta %s  %.1fx', 'running', repeat('#', least(24, greatest(0, floor(value / 4427.028 * 24)))::int), repeat('-', 24 - least(24, greatest(0, floor(value / 4427.028 * 24)))::int),
  round_even(value / 4427.028 * 100, 0), {CLOCK('value')}, '1:13:47', {CLOCK('(event_id / 100.0)')}, {CLOCK('(case when v > 0 then (4427.028 - value) / v end)')}, round_even(v, 1) + 0.0::double) as bar from p""",
    "scalars": """select o_orderkey, o_orderkey / 16000.0::double as seconds, round(case when o_orderkey % 4 <> 0 then o_custkey::double / (o_orderkey % 4) end, 6) as rate, case when o_orderkey % 5 <> 0 then (o_orderkey * 1000)::double / 1e6::double end as out_s,
  o_orderkey || '.mov' as base, '/media/' || o_orderstatus || '/' || o_orderkey || '.mov.ckpt' as checkpoint, not (o_orderstatus = 'F' and o_orderkey % 2 + 1 = 1) as convert, greatest(2, round_even(o_custkey / 60.0::double, 0)::int) as budget from orders""",
    "first_difference": "select doc_id as rec_id, false as left_missing, doc_id % 7 = 3 as right_missing from documents where doc_id % 7 = 3 or doc_id % 10 = 0 and n_chars is not null",
    "added_keys": "select doc_id as rec_id, case when n_chars is null then '' else 'marks' end as added, case when doc_id % 2 = 0 or n_chars is null then '' else 'n_chars' end as removed from documents",
    "size_overhead": "with j as (select doc_id as rec_id, length('{\"a\":' || doc_id || ',\"b\":' || quality || '}')::double as n from labels) select rec_id, v as variant, round((n + case when v = 'speaker' then length(',\"speaker\":\"SPEAKER_00\"') else 0 end) / n - 1, 6) as overhead from j, (values ('speaker'), ('same')) t(v)",
    "arm_totals": "select user_id % 3 as arm, count(*) filter (where event_type = 'view') as correct, count(*) filter (where event_type = 'click') as hedge, count(*) filter (where event_type not in ('view', 'click')) as fabricate from events group by 1",
    "lookup_known": "select doc_id, lang, quality from documents join labels using (doc_id)",
    "lookup_skipped": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "first_n": f"with {EV} select rec_id, i, value from ev order by rec_id, i limit 25",
    "progress_clock": f"select event_id, {CLOCK('value * 20')} as at, round(value / 4427.028, 6) as fraction, round(case when event_id / 100.0 > 0 then (value - 2.0) / (event_id / 100.0) else 0.0 end, 6) as speed, {CLOCK('(case when event_id > 0 and value - 2.0 > 0 then (4427.028 - value) / ((value - 2.0) / (event_id / 100.0)) end)')} as eta from events",
    "checkpoint_judged": r"""with c as (select doc_id as rec_id, doc_id % 16 as k, '/media/' || coalesce(source, 'none') as media, doc_id::varchar as i,
  '{"id": ' || doc_id::varchar || ', "text": " a", "start": ' || (doc_id % 7)::varchar || '.25, "duration": 1, "confidence": 0.5}' as tok from documents),
d as (select rec_id, media, case k when 15 then null when 14 then '{' else '{"fingerprint": {"media": "' || media || '", "size": ' || case k when 6 then i || '.0' when 1 then '-1' else i end
  || case k when 2 then '' else ', "chunk_s": 120' end || case k when 3 then ', "more": 1' else '' end || '}, "next_start": '
  || case k when 4 then '"' || i || '"' when 5 then i || '.0' when 7 then 'true' else i end || ', "tokens": '
  || case k when 12 then '"nope"' when 13 then '[]' else '[' || case k when 8 then '{"id": 1, "text": "a", "start": 0, "duration": 1}' when 9 then '{"id": 1.5, "text": "a", "start": 0, "duration": 1, "confidence": 1}'
  when 10 then '7' when 11 then '{"id": 1, "text": 2, "start": 0, "duration": 1, "confidence": 1}' else tok end || ', {"id": 2, "text": "b", "start": 1, "duration": 0.5, "confidence": 1}]' end || '}' end as doc from c),
j as (select *, try_cast(doc as json) as js from d),
f as (select *, js->'$.fingerprint' as fp, json_extract(js, '$.tokens[*]') as toks from j),
v as (select *, case when js is null or json_type(js) <> 'OBJECT' then 'json'
  when not coalesce(list_sort(json_keys(fp)) = ['chunk_s', 'media', 'size'] and json_type(fp, '$.media') = 'VARCHAR' and fp->>'$.media' = media and json_type(fp, '$.size') in ('UBIGINT', 'BIGINT', 'DOUBLE')
    and (fp->>'$.size')::double = rec_id and json_type(fp, '$.chunk_s') in ('UBIGINT', 'BIGINT', 'DOUBLE') and (fp->>'$.chunk_s')::double = 120, false) then 'fingerprint'
  when coalesce(json_type(js, '$.next_start'), '') not in ('UBIGINT', 'BIGINT') then 'next_start'
  when coalesce(json_type(js, '$.tokens'), '') <> 'ARRAY' or not coalesce(list_bool_and(list_transform(toks, lambda t: coalesce(json_type(t, '$.id') in ('UBIGINT', 'BIGINT') and json_type(t, '$.text') = 'VARCHAR'
    and json_type(t, '$.start') in ('UBIGINT', 'BIGINT', 'DOUBLE') and json_type(t, '$.duration') in ('UBIGINT', 'BIGINT', 'DOUBLE') and json_type(t, '$.confidence') in ('UBIGINT', 'BIGINT', 'DOUBLE'), false))), true) then 'tokens' end as void from f)
select rec_id, void, case when void is null then (js->>'$.next_start')::bigint end as next_start, case when void is null then len(toks)::int end as n_tokens,
  case when void is null then round(coalesce(list_sum(list_transform(toks, lambda t: (t->>'$.start')::double + (t->>'$.duration')::double)), 0.0), 6) end as seconds from v""",
    "fingerprint_match": "select doc_id from documents where lang = 'en' and source = 'src7' and doc_id % 10 = 7 or lang = 'de' and source = 'src4' and doc_id % 10 = 4",
}
