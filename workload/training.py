"""Sampling, rendering, tokens, features, tagging and scores over address cohorts."""

from pyspark.sql import functions as F

from gableframe.functions import cohort as C
from gableframe.functions import tokens as T
from gableframe.operators import crf
from gableframe.operators import labelling as L
from gableframe.operators import sampling as S
from gableframe.operators import scoring as R
from gableframe.operators.hedonic import hedonic
from gableframe.plans import rendering as X
from gableframe.plans.cohort import has_signal, without_copies
from gableframe.scratch import shared_folder
from gableframe.schema import RENDER_LABELS
from workload.addresses import COHORT, cohort
from workload.decoding import counted, decoded, with_marginals
from workload.registry import certificates, lake, on_sales, register
from workload.twins import CERTS, LAKE
from workload.views import table

SEED = 2025
COHORT_FIELDS = (
    "property_type", "BuildingName", "BuildingNumber", "SubBuildingName", "StreetName", "Locality", "TownName", "Postcode",
)
KEYED = COHORT + ", ids as (select distinct *, concat_ws('~', " + ", ".join(
    f"coalesce(\"{c}\", '')" for c in COHORT_FIELDS
) + ") as id from cohort)\n"


def keyed(spark, sf_dir):
    """Distinct cohort rows with the text of their fields as key."""
    key = F.concat_ws("~", *[F.coalesce(F.col(c), F.lit("")) for c in COHORT_FIELDS])
    return without_copies(cohort(spark, sf_dir)).withColumn("id", key)


def address_stratum():
    return C.stratum(*[F.col(c) for c in ("BuildingName", "BuildingNumber", "SubBuildingName", "property_type")])


FLAT_WORDS = "APARTMENT|ANNEXE|STUDIO|APPTS|ANNEX|BLOCK|FLAT|ROOM|UNIT|APT|BLK"
STRATUM = rf"""case when coalesce("BuildingName", '') <> '' and coalesce("BuildingNumber", '') <> '' then 'name+number'
    when coalesce("BuildingNumber", '') <> '' then 'number' when coalesce("BuildingName", '') <> '' then 'name' else 'none' end
    || '|' || case when trim(coalesce("SubBuildingName", '')) = '' then 'none'
    when regexp_matches(trim("SubBuildingName"), '(?i)^\s*({FLAT_WORDS})\b') then 'flat'
    when regexp_matches(trim("SubBuildingName"), '^\d+$') then 'num'
    when regexp_matches(trim("SubBuildingName"), '^(?:\d+[A-Za-z]|[A-Za-z]\d+)\w*$') then 'alnum' else 'name' end
    || '|' || coalesce(nullif(upper(trim("property_type")), ''), 'NA')"""


def balanced(source, key, stratum, n, cols):
    """Twin of the balanced sample: shares first, then the rest, both in hash order."""
    return f""", hashed as (select *, {stratum} as s, md5('{SEED}|' || {key}) as h from {source}), ranked as (
    select *, row_number() over (partition by s order by h) as r,
      greatest(1, {n} // (select count(distinct s) from hashed)) as quota from hashed), tiered as (
    select *, row_number() over (order by case when r <= quota then 0 else 1 end, h) as place from ranked)
    select {cols} from tiered where place <= {n}"""


register(
    "balanced_sample_addresses",
    lambda s, d: S.balanced_sample(keyed(s, d), 300, "id", address_stratum(), SEED).select("id"),
    KEYED + balanced("ids", "id", STRATUM, 300, "id"),
)
register(
    "balanced_sample_documents",
    lambda s, d: S.balanced_sample(
        table(s, d, "documents"), 200, "doc_id", F.concat_ws("|", "lang", "source"), SEED
    ).select("doc_id", "lang", "source"),
    "with t as (select 1)"
    + balanced("documents", "doc_id::varchar", "lang || '|' || source", 200, "doc_id, lang, source"),
)
register(
    "balanced_sample_more_strata_than_rows",
    lambda s, d: S.balanced_sample(table(s, d, "documents"), 7, "doc_id", F.concat_ws("|", "lang", "source"), SEED).select(
        "doc_id"
    ),
    "with t as (select 1)" + balanced("documents", "doc_id::varchar", "lang || '|' || source", 7, "doc_id"),
)
register(
    "stratum_counts",
    lambda s, d: S.group_counts(keyed(s, d).withColumn("stratum", address_stratum()), "stratum"),
    KEYED + f"select {STRATUM} as stratum, count(*) as n from ids group by 1",
)
register(
    "random_subset",
    lambda s, d: S.random_subset(table(s, d, "documents"), 150, "doc_id", SEED).select("doc_id"),
    f"select doc_id from documents order by md5('{SEED}|' || doc_id::varchar) limit 150",
)


def drawn(key, purpose):
    return f"(('0x' || substr(md5('{SEED}|{purpose}|' || {key}), 1, 8))::bigint / 4294967296.0)"


register(
    "train_holdout_split",
    lambda s, d: S.train_holdout(table(s, d, "documents"), "doc_id", 0.2, SEED).select("doc_id", "split"),
    f"select doc_id, case when {drawn('doc_id::varchar', 'split')} < 0.2 then 'test' else 'train' end as split from documents",
)
register(
    "train_holdout_counts",
    lambda s, d: S.group_counts(S.train_holdout(keyed(s, d), "id", 0.2, SEED), "split"),
    KEYED
    + f"select case when {drawn('id', 'split')} < 0.2 then 'test' else 'train' end as split, count(*) as n from ids group by 1",
)

# --- rendering ---------------------------------------------------------------------


def list_words(c):
    return rf"list_filter(string_split_regex(trim(coalesce({c}, '')), '\s+'), lambda w: w <> '')"


def choice(u, options):
    reached, out = 0.0, "case"
    for chance, names in options[:-1]:
        reached += chance
        out += f" when {u} < {round(reached, 6)} then {list(names)}"
    return out + f" else {list(options[-1][1])} end"


PARTS = ", ".join(f'{list_words(chr(34) + n + chr(34))} as "t{n}"' for n in RENDER_LABELS if n != "Postcode")
RENDERED = KEYED + f""", parts as (select id, property_type, {PARTS}, ["Outcode", "Incode"] as "tPostcode",
    {drawn('id', 'front')} as uf, {drawn('id', 'back')} as ub from ids), ordered as (
  select *, list_concat(case
    when (upper(property_type) = 'F' or len("tSubBuildingName") > 0) and len("tStreetName") > 0 then {choice('uf', X.FLAT_ORDERS)}
    when len("tBuildingName") > 0 and len("tBuildingNumber") > 0 and len("tStreetName") > 0 then {choice('uf', X.NAMED_NUMBER_ORDERS)}
    when len("tBuildingNumber") > 0 and len("tStreetName") > 0 then {choice('uf', X.NUMBER_ORDERS)}
    when len("tBuildingName") > 0 and len("tStreetName") > 0 then {choice('uf', X.NAME_ORDERS)}
    else {list(X.NO_STREET_ORDER)} end, {choice('ub', X.PLACE_ORDERS)}, ['Postcode']) as labels from parts), rendered as (
  select id, flatten(list_transform(labels, lambda l: list_transform(case l
    {' '.join(f"when '{n}' then " + f'"t{n}"' for n in RENDER_LABELS)} end, lambda t: {{'token': t, 'label': l}}))) as labelled
  from ordered)
"""


def shown(pairs="labelled"):
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["token"], F.lit("/"), p["label"])), " ")


SHOWN = "array_to_string(list_transform(labelled, lambda p: p.token || '/' || p.label), ' ')"


def labelled(spark, sf_dir):
    return X.render_labelled(keyed(spark, sf_dir), "id", SEED)


register(
    "render_labelled",
    lambda s, d: labelled(s, d).select("id", shown().alias("shown")),
    RENDERED + f"select id, {SHOWN} as shown from rendered",
)
RANDOM_LABELS = [n for n in RENDER_LABELS if n != "Postcode"]
register(
    "render_random_order",
    lambda s, d: X.render_labelled(keyed(s, d), "id", SEED, realistic=False).select("id", shown().alias("shown")),
    RENDERED.rsplit(", ordered as (", 1)[0]
    + f""", shuffled as (select *, list_transform(list_sort(list_filter([{', '.join(
        f"{{'u': {drawn('id', 'order ' + n)}, 'label': '{n}', 'has': len(" + f'"t{n}"' + ") > 0}" for n in RANDOM_LABELS
    )}], lambda o: o.has)), lambda o: o.label) as base,
    case when len("tBuildingNumber") > 0 and len("tBuildingName") > 0 then
        case when {drawn('id', 'target')} < 0.6 then 'BuildingNumber' else 'BuildingName' end
      when len("tBuildingNumber") > 0 then 'BuildingNumber' when len("tBuildingName") > 0 then 'BuildingName' end as target,
    {drawn('id', 'move')} as um from parts), ordered as (
    select *, list_concat(case when len("tStreetName") > 0 and target is not null and um < 0.7 then
      flatten(list_transform(list_filter(base, lambda l: l <> 'StreetName'),
        lambda l: case when l = target then [l, 'StreetName'] else [l] end)) else base end, ['Postcode']) as labels
    from shuffled), rendered as ("""
    + RENDERED.rsplit(", rendered as (", 1)[1]
    + f"select id, {SHOWN} as shown from rendered",
)


def xml_round_trip(compress):
    def run(spark, sf_dir):
        path = shared_folder(spark, "labelled-xml")
        X.write_labelled_xml(
            S.train_holdout(labelled(spark, sf_dir), "id", 0.2, SEED), path, "id", rows_per_shard=200, compress=compress
        )
        read = X.read_labelled_xml(spark, path)
        return read.select("split", "raw_text", shown().alias("shown"))

    return run


_XML = RENDERED + f"""select case when {drawn('id', 'split')} < 0.2 then 'test' else 'train' end as split,
    array_to_string(list_transform(labelled, lambda p: p.token), '') as raw_text, {SHOWN} as shown from rendered"""
register("labelled_xml", xml_round_trip(False), _XML)
register("labelled_xml_gz", xml_round_trip(True), _XML)


def shard_sizes(spark, sf_dir):
    path = shared_folder(spark, "xml-shards")
    split = S.train_holdout(labelled(spark, sf_dir), "id", 0.2, SEED)
    X.write_labelled_xml(split, path, "id", rows_per_shard=200)
    return X.read_labelled_xml(spark, path).groupBy("split", "shard").agg(F.count(F.lit(1)).alias("n"))


register(
    "labelled_xml_shards",
    shard_sizes,
    KEYED
    + f""", c as (select case when {drawn('id', 'split')} < 0.2 then 'test' else 'train' end as split, id from ids), n as (
    select split, (row_number() over (partition by split) - 1) // 200 as shard from c)
    select split, shard, count(*) as n from n group by 1, 2""",
)


def signal_sample(spark, sf_dir):
    """The training-data job in one: signal filter, balanced sample, split, counts."""
    rows = keyed(spark, sf_dir).where(has_signal(*[F.col(c) for c in ("BuildingNumber", "BuildingName", "StreetName")]))
    sample = S.balanced_sample(rows, 400, "id", address_stratum(), SEED)
    return S.group_counts(S.train_holdout(sample, "id", 0.2, SEED), "split")


register(
    "training_sample_counts",
    signal_sample,
    KEYED
    + """, sig as (select * from ids where coalesce(trim("BuildingNumber"), '') <> '' or coalesce(trim("BuildingName"), '') <> ''
    or coalesce(trim("StreetName"), '') <> '')"""
    + balanced("sig", "id", STRATUM, 400, "id").replace("select id from tiered", ", picked as (select id from tiered")
    + f""") select case when {drawn('id', 'split')} < 0.2 then 'test' else 'train' end as split, count(*) as n
    from picked group by 1""",
)

# --- tokens ------------------------------------------------------------------------

SYNONYMS = {"RD": "ROAD", "ST": "STREET", "AVE.": "AVENUE", "GDNS": "GARDENS", "APT": "APARTMENT", "STUDIO": "STUDIO FLAT"}


def address_lines(spark, sf_dir):
    return certificates(spark, sf_dir).select(
        "LMK_KEY", F.concat_ws(", ", "ADDRESS1", "ADDRESS2", "ADDRESS3", "POSTTOWN", "POSTCODE").alias("line")
    )


_LINE = CERTS + """, lines as (select "LMK_KEY", concat_ws(', ', "ADDRESS1", "ADDRESS2", "ADDRESS3", "POSTTOWN", "POSTCODE") as line
  from certs)
"""
_SYN = " ".join(f"when '{k}' then '{v}'" for k, v in SYNONYMS.items())
TOKENS = _LINE + rf""", r1 as (select "LMK_KEY", regexp_replace(regexp_replace(regexp_replace(upper(line),
    '(\d+[A-Z]?) *- *(\d+[A-Z]?)', '\1-\2', 'g'), '(\d+)/(\d+)', '\1-\2', 'g'), '(\d+) *TO *(\d+)', '\1-\2', 'g') as t from lines),
  r2 as (select "LMK_KEY", array_to_string(list_transform(list_filter(string_split_regex(
    replace(replace(replace(replace(replace(t, ' IN ', ' '), ' CO ', ' '), ' - ', ' '), ',', ' '), '\', ' '), '\s+'),
    lambda w: w <> ''), lambda w: case w {_SYN} else w end), ' ') as t from r1),
  tokens as (select "LMK_KEY", regexp_extract_all(t, '\(*\b[^\s,;#&()]+[.,;)\n]*|[#&]') as tokens from r2)
"""
PLAIN = T.Lookups(synonyms=SYNONYMS)
register(
    "tokenize_addresses",
    lambda s, d: address_lines(s, d).select(
        "LMK_KEY", F.array_join(T.tokenize(F.col("line"), PLAIN), "|").alias("tokens")
    ),
    TOKENS + """select "LMK_KEY", array_to_string(tokens, '|') as tokens from tokens""",
)


# Regions stand in for counties, then customers by rule.
COUNTIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", *[f"CUSTOMER#{i:09d}" for i in range(222)]]


def place_lookups(spark, sf_dir):
    """Regions and market segments stand in for counties and post towns."""
    towns = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return T.Lookups(
        counties=COUNTIES,
        synonyms=SYNONYMS,
        outcodes=["GL1", "GL52", "SW1", "EX3"],
        posttowns=sorted(r.c_mktsegment for r in towns.toLocalIterator()),
    )


def county_lines(spark, sf_dir):
    """Address lines that name a region, some of them where it must stay."""
    return lake(spark, sf_dir).select(
        "Transaction ID",
        F.concat_ws(
            " ", "PAON", F.when(F.col("`Transaction ID`").cast("bigint") % 3 == 0, F.lit("upon")), "County", "Street", "County"
        ).alias("line"),
    )


REGIONS = "|".join(COUNTIES)
_KEPT = "|".join(dict.fromkeys([*T.KEPT_BEFORE, *T.COMPANY, *T.FLAT, *T.RESIDENTIAL, *T.ROAD]))


def without_regions(c):
    """DuckDB has no look-around: names that stay are marked and put in lower case, the rest is removed."""
    marked = rf"regexp_replace(regexp_replace({c}, '\b(ON|DINAS|UPON|[0-9])\s({REGIONS})', '\1 ~\2', 'g'), "
    marked += rf"'({REGIONS})(\s(?:{_KEPT})\b)', '~\1\2', 'g')"
    for name in REGIONS.split("|"):
        marked = f"replace({marked}, '~{name}', '~{name.lower()}')"
    return f"upper(replace(regexp_replace({marked}, '{REGIONS}', '', 'g'), '~', ''))"


COUNTY_LINES = LAKE + """, lines as (select "Transaction ID", upper(concat_ws(' ', "PAON",
    case when "Transaction ID"::bigint % 3 = 0 then 'upon' end, "County", "Street", "County")) as line from lake)
"""
register(
    "remove_counties",
    lambda s, d: county_lines(s, d).select(
        "Transaction ID", T.remove_counties(F.upper("line"), place_lookups(s, d).counties).alias("line")
    ),
    COUNTY_LINES + f"""select "Transaction ID", {without_regions('line')} as line from lines""",
)
register(
    "tokenize_with_counties",
    lambda s, d: county_lines(s, d).select(
        "Transaction ID", F.array_join(T.tokenize(F.col("line"), place_lookups(s, d)), "|").alias("tokens")
    ),
    COUNTY_LINES
    + rf""", r0 as (select "Transaction ID", {without_regions('line')} as line from lines),
    r1 as (select "Transaction ID", regexp_replace(regexp_replace(regexp_replace(line,
    '(\d+[A-Z]?) *- *(\d+[A-Z]?)', '\1-\2', 'g'), '(\d+)/(\d+)', '\1-\2', 'g'), '(\d+) *TO *(\d+)', '\1-\2', 'g') as t from r0),
    r2 as (select "Transaction ID", array_to_string(list_transform(list_filter(string_split_regex(
    replace(replace(replace(replace(replace(t, ' IN ', ' '), ' CO ', ' '), ' - ', ' '), ',', ' '), '\', ' '), '\s+'),
    lambda w: w <> ''), lambda w: case w {_SYN} else w end), ' ') as t from r1)
    select "Transaction ID", array_to_string(regexp_extract_all({without_regions('t')},
    '\(*\b[^\s,;#&()]+[.,;)\n]*|[#&]'), '|') as tokens from r2""",
)
# Its letters go beyond those that DuckDB's word boundary knows: compared with Python's in tests.
register(
    "tokenize_documents",
    lambda s, d: table(s, d, "documents").select(
        "doc_id", F.size(T.tokenize(F.col("text"), place_lookups(s, d))).alias("tokens")
    ),
)
PLACES = ("rawstring_start", "rawstring_end", "singleton", "previous_is_start", "next_is_end")
FEATURE_LOOKUPS = T.Lookups(outcodes=("GL1", "SW2"), posttowns=("BUILDING", "MACHINERY"))


def among(names):
    return "upper(t) in (" + ", ".join(f"'{n}'" for n in names) + ")"


FEATURES = rf"""case when regexp_matches(t, '^\d+$') then 'all_digits' when regexp_matches(t, '[0-9]') then 'some_digits'
    else 'no_digits' end as digits, case when not regexp_matches(upper(t), '^\d+$') then upper(t) end as word,
    case when regexp_matches(t, '^\d+$') then 'd:' else 'w:' end || length(t)::varchar as length,
    case when regexp_matches(t, '^.+\.$') then right(t, 1) end as endsinpunc, {among(T.DIRECTIONS)} as directional,
    upper(t) in ('GL1', 'SW2') as outcode, upper(t) in ('BUILDING', 'MACHINERY') as posttown,
    regexp_matches(upper(t), '[AEIOU]') as has_vowels, """ + ", ".join(
    f"{among(v)} as {k}" for k, v in T.FLAGS.items() if k != "directional"
) + ", (length(t) - length(replace(t, '-', '')))::bigint as hyphenations"
register(
    "token_features",
    lambda s, d: address_lines(s, d)
    .select(F.explode(T.tokenize(F.col("line"), PLAIN)).alias("token"))
    .groupBy("token")
    .agg(F.count(F.lit(1)).alias("n"))
    .select("token", "n", T.token_features(F.col("token"), FEATURE_LOOKUPS).alias("f"))
    .select("token", "n", "f.*"),
    TOKENS
    + f", u as (select t, count(*) as n from (select unnest(tokens) as t from tokens) group by 1) select t as token, n, {FEATURES} from u",
)
register(
    "sequence_features",
    lambda s, d: T.sequence_features(
        address_lines(s, d).select("LMK_KEY", T.tokenize(F.col("line"), PLAIN).alias("tokens")), "tokens", FEATURE_LOOKUPS
    )
    # The wanted features as a column first: the planner makes it along with all features, which are then not
    # written out. The generator gets no bare column, as the planner would filter by its size and make it anew for that.
    .select(
        "LMK_KEY",
        F.transform(
            "features",
            lambda f: F.struct(
                f["own"]["length"].alias("own"), f["previous"]["digits"].alias("previous"), f["next"]["word"].alias("next"),
                *[f[c].alias(c) for c in PLACES],
            ),
        ).alias("wanted"),
    )
    .select(
        "LMK_KEY",
        F.inline(
            F.transform(
                "wanted",
                lambda f, i: F.struct(i.alias("pos"), *[f[c].alias(c) for c in ("own", "previous", "next", *PLACES)]),
            )
        ),
    ),
    TOKENS
    + r""", e as (select "LMK_KEY", len(tokens) as n, unnest(tokens) as t, generate_subscripts(tokens, 1) - 1 as pos from tokens)
    select "LMK_KEY", pos::bigint as pos, case when regexp_matches(t, '^\d+$') then 'd:' else 'w:' end || length(t)::varchar as own,
    case when regexp_matches(lag(t) over w, '^\d+$') then 'all_digits' when regexp_matches(lag(t) over w, '[0-9]') then 'some_digits'
      when lag(t) over w is not null then 'no_digits' end as previous,
    case when not regexp_matches(lead(t) over w, '^\d+$') then lead(t) over w end as next,
    pos = 0 and n > 1 as rawstring_start, pos = n - 1 and n > 1 as rawstring_end, n = 1 as singleton,
    pos = 1 as previous_is_start, pos = n - 2 and n > 1 as next_is_end
    from e window w as (partition by "LMK_KEY" order by pos)""",
)

# --- scores ------------------------------------------------------------------------


def two_sequences(spark, sf_dir):
    """Line flags of each order, and what a crude rule says they are."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("t"),
            F.when(F.col("l_quantity") > 6, F.col("l_returnflag")).otherwise("A").alias("p"),
        ).alias("x"),
    )
    per_order = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return per_order.select(
        F.transform("xs", lambda x: x["t"]).alias("true"), F.transform("xs", lambda x: x["p"]).alias("predicted")
    )


SEQUENCES = """with f as (select l_orderkey, l_returnflag as t, case when l_quantity > 6 then l_returnflag else 'A' end as p
    from lineitem)"""
REPORT = SEQUENCES + """, l as (select distinct t as label from f union select distinct p from f), r as (
    select label, count(*) filter (where p = label and t = label) as hit, count(*) filter (where p = label) as claimed,
    count(*) filter (where t = label) as support from l, f group by 1), s as (
    select label, case when claimed > 0 then hit / claimed else 0 end as pr, case when support > 0 then hit / support else 0 end as re,
    2.0 * hit / (claimed + support) as f1, support from r)
"""
register(
    "sequence_accuracy",
    lambda s, d: R.sequence_accuracy(two_sequences(s, d)),
    SEQUENCES
    + """select round(avg(case when same then 1.0 else 0.0 end), 6) as sequence_accuracy, count(*) as sequences
    from (select l_orderkey, bool_and(t = p) as same from f group by 1)""",
)
register(
    "label_report",
    lambda s, d: R.label_report(two_sequences(s, d)),
    REPORT + "select label, round(pr, 6) as precision, round(re, 6) as recall, round(f1, 6) as f1, support from s",
)
register(
    "weighted_f1",
    lambda s, d: R.weighted_f1(two_sequences(s, d)),
    REPORT + "select round(sum(f1 * support) / sum(support), 6) as weighted_f1, sum(support)::bigint as tokens from s",
)

# --- labelling ---------------------------------------------------------------------

register(
    "label_word_counts",
    lambda s, d: L.counts_per_label(L.label_events(labelled(s, d)), "word", RENDER_LABELS),
    RENDERED
    + ", e as (select unnest(labelled) as p from rendered) select upper(p.token) as word, "
    + ", ".join(f"""count(*) filter (where p.label = '{n}') as "{n}" """ for n in RENDER_LABELS)
    + " from e group by 1",
)
register(
    "label_transition_counts",
    lambda s, d: L.label_events(labelled(s, d)).where("kind = 'before'").select(
        F.col("value").alias("before"), "label", "n"
    ),
    RENDERED
    + """, e as (select id, unnest(labelled) as p, generate_subscripts(labelled, 1) as pos from rendered), m as (
    select coalesce(lag(p.label) over (partition by id order by pos), '^') as before, p.label as label from e)
    select before, label, count(*) as n from m group by 1, 2""",
)


def fitted(spark, sf_dir):
    """Counts of the training split, and the holdout split."""
    split = S.train_holdout(labelled(spark, sf_dir), "id", 0.2, SEED).withColumn(
        "given", F.transform("labelled", lambda p: p["token"])
    )
    counts = L.fit_labels(split.where(F.col("split") == "train"), labels=RENDER_LABELS)
    return counts, split.where(F.col("split") == "test")


def holdout(spark, sf_dir, **options):
    counts, test = fitted(spark, sf_dir)
    return L.tag_tokens(test, "given", counts, **options)


MODEL = RENDERED.rstrip() + counted(f"select id, labelled, {drawn('id', 'split')} < 0.2 as test from rendered")
HELD_OUT = MODEL + decoded(
    "select id as key, list_transform(labelled, lambda p: p.token) as tokens from tg_split where test and len(labelled) > 0"
)
TRUE_AND_FOUND = HELD_OUT + """, both_ways as (select list_transform(labelled, lambda p: p.label) as t, labels as p
    from tagged join tg_split on id = key)"""
TOKEN_PAIRS = TRUE_AND_FOUND + ", f as (select unnest(t) as t, unnest(p) as p from both_ways)"
register(
    "holdout_report",
    lambda s, d: R.label_report(L.true_and_predicted(holdout(s, d))),
    REPORT.replace(SEQUENCES, TOKEN_PAIRS)
    + "select label, round(pr, 6) as precision, round(re, 6) as recall, round(f1, 6) as f1, support from s",
)
register(
    "holdout_sequence_accuracy",
    lambda s, d: R.sequence_accuracy(L.true_and_predicted(holdout(s, d))),
    TRUE_AND_FOUND
    + """select round(avg(case when t = p then 1.0 else 0.0 end), 6) as sequence_accuracy, count(*) as sequences from both_ways""",
)
register(
    "holdout_weighted_f1_joined_words",
    lambda s, d: R.weighted_f1(L.true_and_predicted(holdout(s, d, head_words=0))),
    REPORT.replace(SEQUENCES, TOKEN_PAIRS)
    + "select round(sum(f1 * support) / sum(support), 6) as weighted_f1, sum(support)::bigint as tokens from s",
)


def tagged_lines(spark, sf_dir):
    """Certificate addresses tagged by the model of the sale addresses."""
    counts, _ = fitted(spark, sf_dir)
    return L.tag_text(address_lines(spark, sf_dir), "line", counts, PLAIN)


# Tables of both sides have names of their own but for the raw sales, of which the cohort is made.
LINES_TAGGED = (
    MODEL
    + ", "
    + TOKENS.removeprefix("with ")
    + decoded("select distinct array_to_string(tokens, '|') as key, tokens from tokens")
    + """, lines_tagged as (select "LMK_KEY", tagged.tokens, labels, probability from tokens
    join tagged on key = array_to_string(tokens.tokens, '|'))
    """
)
register(
    "parse_addresses",
    lambda s, d: tagged_lines(s, d).select("LMK_KEY", F.to_json(L.parse(F.col("tagged"))).alias("pairs")),
    LINES_TAGGED
    + """select "LMK_KEY", to_json(list_transform(list_zip(tokens, labels),
    lambda z: {'token': z[1], 'label': z[2]}))::varchar as pairs from lines_tagged""",
)
register(
    "parse_with_marginals",
    lambda s, d: tagged_lines(s, d)
    .select("LMK_KEY", F.inline(L.parse_with_marginals(F.col("tagged"))))
    .groupBy("label")
    .agg(F.count(F.lit(1)).alias("tokens"), F.min("marginal").alias("lowest"), F.max("marginal").alias("highest")),
    LINES_TAGGED
    + with_marginals()
    + """, each as (select unnest(marked.labels) as label, unnest(marginals) as marginal from tokens
    join marked on key = array_to_string(tokens.tokens, '|'))
    select label, count(*) as tokens, round(min(marginal), 6) as lowest, round(max(marginal), 6) as highest
    from each group by label""",
)
register(
    "parse_with_probabilities",
    lambda s, d: tagged_lines(s, d)
    .select("LMK_KEY", L.parse_with_probabilities(F.col("tagged")).alias("x"))
    .select("LMK_KEY", F.size("x.tokens").alias("tokens"), "x.sequence_probability"),
    LINES_TAGGED
    + """select "LMK_KEY", len(tokens) as tokens, round(probability, 6) as sequence_probability from lines_tagged""",
)
register(
    "tag_components",
    lambda s, d: tagged_lines(s, d)
    .select("LMK_KEY", L.components(F.col("tagged")["pairs"]).alias("parts"))
    .select("LMK_KEY", *[F.try_element_at("parts", F.lit(n)).alias(n) for n in RENDER_LABELS]),
    LINES_TAGGED
    + 'select "LMK_KEY", '
    + ", ".join(
        f"""case when list_contains(labels, '{n}') then trim(array_to_string(list_transform(list_filter(
        list_zip(tokens, labels), lambda z: z[2] = '{n}'), lambda z: z[1]), ' '), ' ,;') end as "{n}" """
        for n in RENDER_LABELS
    )
    + " from lines_tagged",
)
register(
    "tune_smoothing",
    lambda s, d: L.tune_smoothing(labelled(s, d), "id", L.draw_smoothing(50, SEED), 3, SEED, labels=RENDER_LABELS),
)

# --- conditional random field ------------------------------------------------------

ATTRIBUTES = rf"""list_concat(list_filter([{', '.join(
    f"'{n}=' || {c}" for n, c in (
        ("digits", r"case when regexp_matches(t, '^\d+$') then 'all_digits' when regexp_matches(t, '[0-9]') then 'some_digits' else 'no_digits' end"),
        ("word", r"case when not regexp_matches(upper(t), '^\d+$') then upper(t) end"),
        ("length", r"case when regexp_matches(t, '^\d+$') then 'd:' else 'w:' end || length(t)::varchar"),
        ("endsinpunc", r"case when regexp_matches(t, '^.+\.$') then right(t, 1) end"),
    )
)}, {', '.join(f"case when {among(v)} then '{k}' end" for k, v in (T.FLAGS | {"outcode": FEATURE_LOOKUPS.outcodes, "posttown": FEATURE_LOOKUPS.posttowns}).items())},
    case when regexp_matches(upper(t), '[AEIOU]') then 'has_vowels' end], lambda x: x is not null),
    list_transform(range(length(t) - length(replace(t, '-', ''))), lambda x: 'hyphenations'))"""
PLACED = RENDERED + f""", e as (select id, len(labelled) as n, unnest(labelled) as p, generate_subscripts(labelled, 1) - 1 as pos from rendered),
    w as (select id, n, pos, p.label as label, p.token as own, lag(p.token) over o as previous, lead(p.token) over o as next,
      lag(p.label) over o as before from e window o as (partition by id order by pos)),
    slots as (unpivot w on own, previous, next into name slot value t),
    tokens as (select t, {ATTRIBUTES} as attributes from (select distinct t from slots)),
    each as (select slot, unnest(attributes) as attribute, label from slots join tokens using (t)),
    met as (select slot, attribute, label, count(*) as n from each group by all)
"""
register(
    "crf_attribute_counts",
    lambda s, d: crf.attribute_counts(labelled(s, d), lookups=FEATURE_LOOKUPS),
    PLACED + "select slot, attribute, label, n from met",
)
NAMES = "[" + ", ".join(f"'{n}'" for n in RENDER_LABELS) + "]"
register(
    "crf_first_gradient",
    lambda s, d: crf.first_gradient(labelled(s, d), labels=RENDER_LABELS, lookups=FEATURE_LOOKUPS),
    PLACED
    + f""", placed as (select label, unnest(list_filter([case when pos = 0 and n > 1 then 'rawstring_start' end,
      case when pos = n - 1 and n > 1 then 'rawstring_end' end, case when n = 1 then 'singleton' end,
      case when pos = 1 then 'previous_is_start' end, case when pos = n - 2 and n > 1 then 'next_is_end' end],
      lambda x: x is not null)) as attribute from w),
    observed as (select slot, attribute, label, n from met union all
      select 'place', attribute, label, count(*) from placed group by all union all
      select 'move', before, label, count(*) from w where before is not null group by all),
    every as (select slot, attribute from (select unnest(['own', 'previous', 'next']) as slot),
      (select distinct attribute from met where slot = 'own') union all
      select 'place', unnest(['rawstring_start', 'rawstring_end', 'singleton', 'previous_is_start', 'next_is_end'])
      union all select 'move', unnest({NAMES})),
    cells as (select slot, attribute, unnest({NAMES}) as label from every),
    whole as (select slot, attribute, sum(n) as n from observed where slot <> 'move' group by all),
    moves as (select sum(n) as n from observed where slot = 'move')
    select slot, attribute, label, round(case when slot = 'move' then (select n from moves) / {len(RENDER_LABELS) ** 2}
      else coalesce(whole.n, 0) / {len(RENDER_LABELS)} end - coalesce(observed.n, 0), 6) + 0.0 as gradient
    from cells left join observed using (slot, attribute, label) left join whole using (slot, attribute)""",
)


def field(spark, sf_dir):
    """A field trained on the training split, and the holdout split."""
    split = S.train_holdout(labelled(spark, sf_dir), "id", 0.2, SEED).withColumn(
        "given", F.transform("labelled", lambda p: p["token"])
    )
    model = crf.fit_field(split.where(F.col("split") == "train"), labels=RENDER_LABELS, lookups=FEATURE_LOOKUPS)
    return model, split.where(F.col("split") == "test")


def field_holdout(spark, sf_dir):
    model, test = field(spark, sf_dir)
    return L.true_and_predicted(crf.tag_with_field(test, "given", model))


# The solver's steps have no SQL: gradients, decoding and scores are compared with plain versions in tests.
register("crf_holdout_report", lambda s, d: R.label_report(field_holdout(s, d)))
register("crf_holdout_sequence_accuracy", lambda s, d: R.sequence_accuracy(field_holdout(s, d)))
register(
    "crf_parse_addresses",
    lambda s, d: crf.tag_with_field(
        address_lines(s, d).withColumn("tokens", T.tokenize(F.col("line"), PLAIN)), "tokens", field(s, d)[0]
    ).select("LMK_KEY", F.to_json(L.parse(F.col("tagged"))).alias("pairs"), "tagged.sequence_probability"),
)
register(
    "tune_crf",
    lambda s, d: crf.tune_field(
        labelled(s, d), "id", crf.draw_penalties(50, SEED), 3, SEED, labels=RENDER_LABELS, lookups=FEATURE_LOOKUPS
    ),
)
on_sales("hedonic", hedonic)
# With one term the effects are differences of means, which SQL can state.
on_sales(
    "hedonic_one_term",
    lambda df: hedonic(df, terms=("Property Type",)),
    """, g as (select "Property Type" as level, avg(ln("Price")) as m from sales where "Property Type" is not null group by 1),
    b as (select m from g order by level limit 1), e as (
    select 'intercept' as term, '' as level, m as coefficient from b union all
    select 'property_type', level, g.m - b.m from g, b where level <> (select min(level) from g))
    select term, level, round(coefficient, 6) as coefficient,
    case when term <> 'intercept' then round((exp(coefficient) - 1) * 100, 6) end as premium_pct from e""",
)
