"""DuckDB SQL that states the address tagger: counts, best label sequence, and its probability."""

from gableframe.functions.tokens import DIRECTIONS, FLAGS
from gableframe.operators.labelling import Smoothing
from gableframe.schema import RENDER_LABELS

K = len(RENDER_LABELS)
EACH = f"range(1, {K + 1})"
NAMES = "[" + ", ".join(f"'{n}'" for n in RENDER_LABELS) + "]"
PER_LABEL = "[" + ", ".join(f"count(*) filter (where label = '{n}')" for n in RENDER_LABELS) + "]"
NONE = "[" + ", ".join("0" for _ in RENDER_LABELS) + "]"
SMOOTHING = Smoothing()


def shape(t: str) -> str:
    """What a token looks like, as one text."""
    flags = ", ".join(
        f"case when upper({t}) in (" + ", ".join(f"'{w}'" for w in names) + f") then '{n}' end"
        for n, names in (FLAGS | {"directional": DIRECTIONS}).items()
    )
    return rf"""concat_ws(' ', case when regexp_full_match({t}, '[0-9]+') then 'all_digits'
      when regexp_matches({t}, '[0-9]') then 'some_digits' else 'no_digits' end, length(upper({t}))::varchar,
      case when regexp_matches(upper({t}), '[AEIOU]') then 'vowels' end, case when contains({t}, '-') then 'dash' end,
      case when regexp_matches({t}, '[.,;)]$') then 'punct' end, {flags})"""


def counted(split: str) -> str:
    """Tables up to the model, from tg_split (id, labelled, test)."""
    return f""", tg_split as ({split}), tg_places as (
    select id, test, unnest(labelled) as p, generate_subscripts(labelled, 1) as pos from tg_split), tg_seen as (
    select upper(p.token) as word, {shape('p.token')} as shape, p.label as label,
      coalesce(lag(p.label) over (partition by id order by pos), '^') as before from tg_places where not test),
    by_word as (select word, {PER_LABEL} as c from tg_seen group by word),
    by_shape as (select shape, {PER_LABEL} as c from tg_seen group by shape),
    by_before as (select before, {PER_LABEL} as c from tg_seen group by before),
    tg_totals as (select {PER_LABEL} as c from tg_seen),
    tg_sizes as (select (select count(*) from by_word) as words, (select count(*) from by_shape) as shapes),
    befores as (select i, coalesce(c, {NONE}) as c from (
      select unnest(range(1, {K + 2})) as i, unnest(list_append({NAMES}, '^')) as b) left join by_before on before = b),
    model as (select list(list_transform(c, lambda x: ln(x + {SMOOTHING.transitions})
      - ln(list_sum(c) + {K} * {SMOOTHING.transitions})) order by i) as m from befores)"""


def decoded(rows: str) -> str:
    """Tables up to tagged (key, tokens, labels, probability), from tg_rows (key, tokens)."""
    a = SMOOTHING.tokens
    best = f"list_transform({EACH}, lambda i: s.v[i] + m[i][j])"
    total = "list_max({0}) + ln(list_sum(list_transform({0}, lambda y: exp(y - list_max({0})))))"
    step = f"""{{'v': list_transform({EACH}, lambda j: list_max({best}) + x.v[j]),
      'a': list_transform({EACH}, lambda j: list_max(s.a) + x.v[j] + ln(list_sum(
        list_transform({EACH}, lambda i: exp(s.a[i] - list_max(s.a) + m[i][j]))))),
      'p': list_transform({EACH}, lambda j: list_append(s.p[list_position({best}, list_max({best}))], j))}}"""
    return f""", tg_asked as ({rows}), tg_words as (
    select key, unnest(tokens) as t, generate_subscripts(tokens, 1) as pos from tg_asked), tg_scored as (
    select t, list_transform({EACH}, lambda j: ln(coalesce(w.c[j], 0) + {a}) - ln(n.c[j] + {a} * (tg_sizes.words + 1))
      + ln(coalesce(s.c[j], 0) + {a}) - ln(n.c[j] + {a} * (tg_sizes.shapes + 1))) as e
    from (select distinct t from tg_words) left join by_word w on w.word = upper(t)
    left join by_shape s on s.shape = {shape('t')}, tg_totals n, tg_sizes), tg_rows as (
    select key, list(t order by pos) as tokens, list({{'v': e, 'a': e, 'p': []::bigint[][]}} order by pos) as es
    from tg_words join tg_scored using (t) group by key), tg_opened as (
    select key, tokens, es, m, {{'v': list_transform({EACH}, lambda j: m[{K + 1}][j] + es[1].v[j]),
      'a': list_transform({EACH}, lambda j: m[{K + 1}][j] + es[1].v[j]),
      'p': list_transform({EACH}, lambda j: [j])}} as first from tg_rows, model), tg_ended as (
    select key, tokens, list_reduce(list_prepend(first, es[2:]), lambda s, x: {step}) as s from tg_opened), tagged as (
    select key, tokens, list_transform(s.p[list_position(s.v, list_max(s.v))], lambda j: {NAMES}[j]) as labels,
      exp(list_max(s.v) - ({total.format('s.a')})) as probability from tg_ended)
"""


def with_marginals() -> str:
    """Tables up to marked (key, labels, marginals), after decoded: forward and backward sums of each place."""
    ahead = f"""list_transform({EACH}, lambda j: list_max(s.v) + x.v[j] + ln(list_sum(
      list_transform({EACH}, lambda i: exp(s.v[i] - list_max(s.v) + m[i][j])))))"""
    back = f"""list_transform({EACH}, lambda i: ln(list_sum(
      list_transform({EACH}, lambda j: exp(m[i][j] + x.v[j] + s.v[j])))))"""
    nothing = "[" + ", ".join("0.0::double" for _ in RENDER_LABELS) + "]"
    return f""", tg_open as (select key, m, first.v as v, list_transform(es, lambda x: {{'v': x.v, 'h': []::double[][]}}) as es
    from tg_opened), tg_sums as (select key,
      list_reduce(list_prepend({{'v': v, 'h': [v]}}, es[2:]), lambda s, x: {{'v': {ahead}, 'h': list_append(s.h, {ahead})}}).h as fore,
      list_reverse(list_reduce(list_prepend({{'v': {nothing}, 'h': [{nothing}]}}, list_reverse(es[2:])),
        lambda s, x: {{'v': {back}, 'h': list_append(s.h, {back})}}).h) as aft from tg_open), tg_all as (
    select key, labels, fore, aft, list_max(fore[-1]) + ln(list_sum(
      list_transform(fore[-1], lambda y: exp(y - list_max(fore[-1]))))) as whole from tg_sums join tagged using (key)),
    marked as (select key, labels, list_transform(range(1, len(labels) + 1), lambda t:
      exp(fore[t][list_position({NAMES}, labels[t])] + aft[t][list_position({NAMES}, labels[t])] - whole)) as marginals from tg_all)
"""
