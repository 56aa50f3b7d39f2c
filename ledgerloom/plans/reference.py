"""Queries of the document-reconciliation operators over the driver's tables, with their SQL.

Readings, labels and printed values are built from the star schema by arithmetic on its keys, so
that SQL can build the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import identifiers, normalize
from ledgerloom.operators import assignment, logs, retrieval, scoring
from ledgerloom.session import latest, table
from ledgerloom.streaming import logs as streams

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- printed values ------------------------------------------------------------------------------

def printed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(9))
    us = F.format_number("l_extendedprice", 2)
    eu = F.translate(us, ",.", ".,")
    bare = F.translate(us, ",", "")
    shown = (
        F.when(k == 0, us).when(k == 1, eu).when(k == 2, bare).when(k == 3, F.concat(F.lit("$ "), us)).when(k == 4, F.concat(us, F.lit(" USD")))
        .when(k == 5, F.concat(us, F.lit("-"))).when(k == 6, F.concat(F.lit("-"), bare)).when(k == 7, F.concat(F.col("l_orderkey").cast("string"), F.lit(",500"))).otherwise(F.lit("n/a"))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("printed"))


_PRINTED = """printed as (select l_orderkey, l_linenumber, us, replace(us, ',', '') as bare, (l_orderkey + l_linenumber) % 9 as k
  from (select *, format('{:,.2f}', l_extendedprice) as us from lineitem)),
shown as (select l_orderkey, l_linenumber, case k when 0 then us when 1 then translate(us, ',.', '.,') when 2 then bare when 3 then '$ ' || us when 4 then us || ' USD'
  when 5 then us || '-' when 6 then '-' || bare when 7 then l_orderkey::varchar || ',500' else 'n/a' end as printed from printed)"""


@query(f"""with {_PRINTED},
b as (select *, regexp_replace(printed, '\\s+', '', 'g') as s from shown),
c as (select *, rtrim(regexp_extract(s, '^([^\\d.,]*)([\\d.,]*\\d[.,]?)([^\\d.,]*)$', 2), '.,') as body, regexp_matches(s, '^([^\\d.,]*)([\\d.,]*\\d[.,]?)([^\\d.,]*)$') as ok, contains(regexp_replace(s, '[\\d.,]', '', 'g'), '-') as neg from b),
d as (select *, length(body) - length(replace(body, '.', '')) as dots, length(body) - length(replace(body, ',', '')) as commas, length(regexp_extract(body, '^(.*)[.,]', 1)) as last from c),
e as (select *, dots + commas = 0 or ((dots = 0 or commas = 0) and (commas >= 1 or dots >= 2) and regexp_matches(body, '^\\d*([.,]\\d{{3}})+$')) as plain from d),
f as (select *, ltrim(regexp_replace(case when plain then body else body[1:last] end, '[.,]', '', 'g'), '0') as whole, rtrim(case when plain then '' else body[last + 2:] end, '0') as fraction from e)
select l_orderkey, l_linenumber, printed, case when ok then (case when neg then '-' else '' end) || (case when whole = '' then '0' else whole end) || (case when fraction = '' then '' else '.' || fraction end) end as number from f""")
def normalize_number(spark, sf_dir):  # noqa: ANN001, ANN201
    return printed_numbers(spark, sf_dir).withColumn("number", normalize.number(F.col("printed")))


@query("""with p as (select o_orderkey, o_orderdate::date as d, o_orderkey % 6 as k from orders),
s as (select o_orderkey, d, case k when 0 then strftime(d, '%m/%d/%Y') when 1 then strftime(d, '%Y-%m-%d') when 2 then strftime(d, '%B ') || day(d)::varchar || ', ' || strftime(d, '%Y')
  when 3 then strftime(d, '%d-%b-%y') when 4 then strftime(d, '%m.%d.%y') else 'due on receipt' end as printed, k from p)
select o_orderkey, printed, case when k < 5 then strftime(d, '%Y-%m-%d') end as day from s""")
def normalize_date(spark, sf_dir):  # noqa: ANN001, ANN201
    k, d = F.pmod("o_orderkey", F.lit(6)), F.col("o_orderdate")
    shown = (
        F.when(k == 0, F.date_format(d, "MM/dd/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "MMMM d, yyyy"))
        .when(k == 3, F.date_format(d, "dd-MMM-yy")).when(k == 4, F.date_format(d, "MM.dd.yy")).otherwise(F.lit("due on receipt"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("printed")).withColumn("day", normalize.date(F.col("printed")))


@query("""with s as (select c_custkey, ['$', 'US Dollars', 'eur', ' £ ', 'Yen', 'pesos'][(c_custkey % 6 + 1)::int] as printed from customer)
select c_custkey, printed, case lower(trim(printed)) when '$' then 'usd' when 'us dollars' then 'usd' when 'eur' then 'eur' when '£' then 'gbp' when 'yen' then 'jpy' end as currency from s""")
def normalize_currency(spark, sf_dir):  # noqa: ANN001, ANN201
    forms = F.array(*[F.lit(x) for x in ("$", "US Dollars", "eur", " £ ", "Yen", "pesos")])
    shown = F.get(forms, F.pmod("c_custkey", F.lit(6)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", shown.alias("printed")).withColumn("currency", normalize.currency(F.col("printed")))


@query("""select p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || chr(10) || p_brand || '   ' || p_type || ' ', '\\s+', ' ', 'g'))) as folded from part""")
def normalize_text(spark, sf_dir):  # noqa: ANN001, ANN201
    messy = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\n"), "p_brand", F.lit("   "), "p_type", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", normalize.text(messy).alias("folded"))


@query()
def normalize_text_unicode(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").select("doc_id", normalize.text_unicode(F.col("text")).alias("folded"))


@query("""with x as (select p_partkey, p_name || ' ' || p_brand as one, p_name || ' ' || p_type as other from part)
select p_partkey, round(1 - levenshtein(one, other) / greatest(length(one), length(other))::double, 6) as similarity from x""")
def text_similarity(spark, sf_dir):  # noqa: ANN001, ANN201
    one, other = F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(normalize.similarity(one, other), 6).alias("similarity"))


@query("""with x as (select distinct l_orderkey, l_quantity::bigint as a, (l_partkey % 50)::bigint as b from lineitem)
select l_orderkey, a, b, case when a = 0 and b = 0 then 1000 when sign(a) <> sign(b) then 0 else (2000 * least(abs(a), abs(b)) + greatest(abs(a), abs(b))) // (2 * greatest(abs(a), abs(b))) end::bigint as close from x""")
def value_closeness(spark, sf_dir):  # noqa: ANN001, ANN201
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("a"), F.pmod("l_partkey", F.lit(50)).cast("long").alias("b")).distinct()
    return x.withColumn("close", normalize.closeness(F.col("a"), F.col("b")))


@query("""with x as (select o_orderkey, '$' || format('{:,.2f}', o_totalprice) || case o_orderkey % 3 when 0 then ' USD' when 1 then ' eur' else '' end as printed from orders),
t as (select o_orderkey, unnest(regexp_extract_all(upper(printed), '(USD|EUR|GBP|CHF|[$£€¥])', 1)) as token from x)
select distinct o_orderkey, token, case token when '$' then 'USD' when '£' then 'GBP' when '€' then 'EUR' when '¥' then 'JPY' else token end as code from t""")
def derived_currency(spark, sf_dir):  # noqa: ANN001, ANN201
    """Currency tokens copied out of printed totals, once per document and token."""
    k = F.pmod("o_orderkey", F.lit(3))
    printed = F.concat(F.lit("$"), F.format_number("o_totalprice", 2), F.when(k == 0, " USD").when(k == 1, " eur").otherwise(""))
    tokens = F.explode(F.regexp_extract_all(F.upper(printed), F.lit("(USD|EUR|GBP|CHF|[$£€¥])"), 1))
    known = F.create_map(*[F.lit(x) for pair in normalize.CURRENCIES.items() for x in pair])
    return table(spark, sf_dir, "orders").select("o_orderkey", tokens.alias("token")).distinct().withColumn("code", known[F.col("token")])


@query("""select l_orderkey, l_linenumber, l_partkey, coalesce(case when l_partkey % 3 <> 0 then 'gross' end, case when l_partkey % 5 <> 0 then 'net' end) as carried from lineitem""")
def cell_resolution(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first fieldtype of a cell that a line carries, gross before net."""
    carried = lambda name, rest: F.when(F.pmod("l_partkey", F.lit(rest)) != 0, F.lit(name))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(carried("gross", 3), carried("net", 5)).alias("carried"))


# --- labels and readings -------------------------------------------------------------------------

def _fields(rows: DataFrame, *named: tuple) -> DataFrame:
    return rows.select("doc", F.explode(F.array(*[F.struct(F.lit(t).alias("fieldtype"), x.alias("text")) for t, x in named])).alias("_f")).select("doc", "_f.*").where("text is not null")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("doc", F.col("o_orderkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    gross, net = cents.cast("string"), F.floor(cents * 4 / 5).cast("long").cast("string")
    return _fields(o, ("amount_total_gross", gross), ("amount_total_net", net), ("customer_id", F.col("o_custkey").cast("string")), ("date_issue", F.date_format("o_orderdate", "yyyy-MM-dd")))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as a backend might read them: by the key, some gross values are filed as net,
    some customers misread, some dates left out, some seen twice."""
    o = table(spark, sf_dir, "orders").withColumn("doc", F.col("o_orderkey"))
    k = F.pmod("o_orderkey", F.lit(20))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    gross, net = cents.cast("string"), F.floor(cents * 4 / 5).cast("long").cast("string")
    return _fields(
        o, ("amount_total_gross", F.when(k == 1, net).when(k != 2, gross)), ("amount_total_net", F.when(k.isin(1, 2), gross).otherwise(net)),
        ("customer_id", F.when(k == 3, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).when(k != 4, F.col("o_custkey").cast("string"))),
        ("date_issue", F.when(k != 5, F.date_format("o_orderdate", "MM/dd/yyyy"))), ("customer_id", F.when(k == 6, F.lit("7"))),
    )


_SIDES = """o as (select o_orderkey as doc, o_orderkey % 20 as k, round(o_totalprice * 100)::bigint as g, floor(round(o_totalprice * 100)::bigint * 4 / 5)::bigint as n, o_custkey::varchar as c, strftime(o_orderdate, '%Y-%m-%d') as d from orders),
gold as (select doc, 'amount_total_gross' as fieldtype, g::varchar as norm from o union select doc, 'amount_total_net', n::varchar from o union select doc, 'customer_id', c from o union select doc, 'date_issue', d from o),
guess as (select * from (select doc, 'amount_total_gross' as fieldtype, case when k = 1 then n::varchar when k <> 2 then g::varchar end as norm from o
  union select doc, 'amount_total_net', case when k in (1, 2) then g::varchar else n::varchar end from o
  union select doc, 'customer_id', case when k = 3 then 'x' || c when k <> 4 then c end from o union select doc, 'date_issue', case when k <> 5 then d end from o
  union select doc, 'customer_id', case when k = 6 then '7' end from o) where norm is not null),
flags as (select coalesce(a.doc, b.doc) as doc, coalesce(a.fieldtype, b.fieldtype) as fieldtype, coalesce(a.norm, b.norm) as norm, (a.doc is not null)::int as gold, (b.doc is not null)::int as guess
  from gold a full join guess b on a.doc = b.doc and a.fieldtype = b.fieldtype and a.norm = b.norm)"""
_COUNTS = "sum(gold * guess)::bigint as matched, sum(gold * (1 - guess))::bigint as missing, sum((1 - gold) * guess)::bigint as spurious"
_PRF = """case when matched + spurious = 0 then 1.0 else matched / (matched + spurious)::double end as p, case when matched + missing = 0 then 1.0 else matched / (matched + missing)::double end as r"""


@query(f"with {_SIDES}, c as (select doc, fieldtype, {_COUNTS} from flags group by all), x as (select *, {_PRF} from c) select doc, fieldtype, matched, missing, spurious, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 6) as f1 from x")
def field_score(spark, sf_dir):  # noqa: ANN001, ANN201
    return scoring.counted(scoring.field_flags(labels(spark, sf_dir), readings(spark, sf_dir), ["doc"]), ["doc", "fieldtype"])


@query(f"with {_SIDES}, c as (select fieldtype, {_COUNTS} from flags group by all), x as (select *, {_PRF} from c) select fieldtype, matched, missing, spurious, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 6) as f1 from x")
def field_micro_f1(spark, sf_dir):  # noqa: ANN001, ANN201
    return scoring.counted(scoring.field_flags(labels(spark, sf_dir), readings(spark, sf_dir), ["doc"]), ["fieldtype"])


@query(f"""with {_SIDES}, m as (select * from flags where gold = 1 and guess = 0), s as (select * from flags where gold = 0 and guess = 1),
f as (select m.doc, m.fieldtype, m.norm, s.fieldtype as other from m join s on m.doc = s.doc and m.norm = s.norm and (m.fieldtype = 'amount_total_gross' and s.fieldtype = 'amount_total_net' or m.fieldtype = 'amount_total_net' and s.fieldtype = 'amount_total_gross')),
l as (select doc, fieldtype, count(*) as m from m where not exists (select 1 from f where f.doc = m.doc and f.fieldtype = m.fieldtype and f.norm = m.norm) group by all),
e as (select doc, fieldtype, count(*) as s from s where not exists (select 1 from f where f.doc = s.doc and f.other = s.fieldtype and f.norm = s.norm) group by all),
b as (select coalesce(l.doc, e.doc) as doc, coalesce(l.fieldtype, e.fieldtype) as fieldtype, coalesce(m, 0) as m, coalesce(s, 0) as s from l full join e on l.doc = e.doc and l.fieldtype = e.fieldtype),
u as (select doc, fieldtype, case when fieldtype like 'date%' then 'misread date' else 'wrong' end as class, least(m, s) as n from b union all select doc, fieldtype, 'missing', m - least(m, s) from b union all select doc, fieldtype, 'spurious', s - least(m, s) from b
  union all select doc, fieldtype, case fieldtype when 'amount_total_gross' then 'net for gross' else 'gross for net' end, 1 from f)
select fieldtype, class, sum(n)::bigint as n, count(distinct doc) as documents from u where n > 0 group by all""")
def error_classes(spark, sf_dir):  # noqa: ANN001, ANN201
    flags = scoring.field_flags(labels(spark, sf_dir), readings(spark, sf_dir), ["doc"])
    return scoring.error_classes(flags, ["doc"])


@query(f"""with {_SIDES} select count(distinct doc) as documents, count(*) as labels, count(distinct (doc, fieldtype)) as fields, count(distinct norm) as values from gold""")
def corpus_survey(spark, sf_dir):  # noqa: ANN001, ANN201
    norm = normalize.comparable(F.col("fieldtype"), F.col("text"))
    return labels(spark, sf_dir).withColumn("norm", norm).agg(F.countDistinct("doc").alias("documents"), F.count("*").alias("labels"), F.countDistinct("doc", "fieldtype").alias("fields"), F.countDistinct("norm").alias("values"))


@query(f"""with {_SIDES}, x as (select case when fieldtype like 'amount%' then 'number' when fieldtype like 'date%' then 'date' else 'text' end as rule, fieldtype from gold)
select rule, fieldtype, count(*) as n from x group by rollup (rule, fieldtype)""")
def rule_rollup(spark, sf_dir):  # noqa: ANN001, ANN201
    rule = F.when(F.col("fieldtype").isin(*normalize.NUMBER_FIELDTYPES), "number").when(F.col("fieldtype").isin(*normalize.DATE_FIELDTYPES), "date").otherwise("text")
    return labels(spark, sf_dir).select(rule.alias("rule"), "fieldtype").rollup("rule", "fieldtype").agg(F.count("*").alias("n"))


@query("""with r as (select l_orderkey as doc, l_returnflag as fieldtype, lower(trim(l_linestatus)) as norm from lineitem)
select fieldtype, count(*) as repeated, sum((values = 1)::int)::bigint as alike from (select doc, fieldtype, count(*) as n, count(distinct norm) as values from r group by all having count(*) > 1) group by fieldtype""")
def header_repeats(spark, sf_dir):  # noqa: ANN001, ANN201
    """Fieldtypes a document lists more than once, and how often all its values agree."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("fieldtype"), normalize.text(F.col("l_linestatus")).alias("norm"))
    per = r.groupBy("doc", "fieldtype").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("values")).where("n > 1")
    return per.groupBy("fieldtype").agg(F.count("*").alias("repeated"), F.count_if(F.col("values") == 1).alias("alike"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(F.pmod("l_partkey", F.lit(13)) != 0, F.pmod("l_suppkey", F.lit(11)) / 10)
    return table(spark, sf_dir, "lineitem").select(confidence.alias("confidence"), F.pmod("l_orderkey", F.lit(3)).cast("int").alias("k")).select("confidence", F.when(F.col("k") > 0, 1).otherwise(0).alias("correct"))


@query("""with j as (select case when l_partkey % 13 <> 0 then (l_suppkey % 11) / 10 end as confidence, case when l_orderkey % 3 > 0 then 1 else 0 end as correct from lineitem),
b as (select case when confidence is null then -1 else (confidence >= .1)::int + (confidence >= .2)::int + (confidence >= .3)::int + (confidence >= .4)::int + (confidence >= .5)::int + (confidence >= .6)::int + (confidence >= .7)::int + (confidence >= .8)::int + (confidence >= .9)::int end as bucket, correct from j),
c as (select bucket, count(*) as n, sum(correct) as correct from b group by bucket)
select r.range::int as bucket, coalesce(n, 0)::bigint as n, coalesce(correct, 0)::bigint as correct, round(correct / n::double, 6) as accuracy from range(-1, 10) r left join c on r.range = c.bucket""")
def calibration(spark, sf_dir):  # noqa: ANN001, ANN201
    return scoring.calibration(_judged(spark, sf_dir))


@query("""with r as (select l_orderkey as doc, max((l_partkey % 17 = 0)::int) = 1 as failed, max((l_partkey % 11 = 0)::int) = 1 as wrong, min(case when l_partkey % 13 <> 0 then (l_suppkey % 11) / 10 end) as least_confidence from lineitem group by 1),
x as (select *, coalesce(least_confidence < edge, false) as low from r, (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[]) as edge))
select edge, count(*) filter (wrong and failed and not low) as check_only, count(*) filter (wrong and not failed and low) as confidence_only, count(*) filter (wrong and failed and low) as both, count(*) filter (wrong and not failed and not low) as neither, count(*) filter (not wrong and low) as false_alarms from x group by edge""")
def confidence_sweep(spark, sf_dir):  # noqa: ANN001, ANN201
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    readings_ = l.groupBy(F.col("l_orderkey").alias("doc")).agg(
        (F.max(F.when(F.pmod("l_partkey", F.lit(17)) == 0, 1).otherwise(0)) == 1).alias("failed"),
        (F.max(F.when(F.pmod("l_partkey", F.lit(11)) == 0, 1).otherwise(0)) == 1).alias("wrong"),
        F.min(F.when(F.pmod("l_partkey", F.lit(13)) != 0, F.pmod("l_suppkey", F.lit(11)) / 10)).alias("least_confidence"),
    )
    return scoring.edge_sweep(readings_)


@query("""select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, count(value) as n from events group by event_type""")
def percentile_rank(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "events").groupBy("event_type").agg(scoring.nearest_rank("value", 50).alias("p50"), scoring.nearest_rank("value", 95).alias("p95"), F.count("value").alias("n"))


_SCORED = "s as (select l_returnflag as stratum, round(l_discount + (l_quantity - l_linenumber) / 100, 4) as score, case when l_partkey % 4 = 0 then 1 else 0 end as positive, 1 + l_linenumber % 3 as weight from lineitem)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("stratum"), F.round(F.col("l_discount") + (F.col("l_quantity") - F.col("l_linenumber")) / 100, 4).alias("score"),
        F.when(F.pmod("l_partkey", F.lit(4)) == 0, 1).otherwise(0).alias("positive"), (1 + F.pmod("l_linenumber", F.lit(3))).alias("weight"),
    )


@query(f"""with {_SCORED}, b as (select stratum, score, sum(positive) as p, sum(1 - positive) as q from s group by all),
u as (select *, p * (coalesce(sum(q) over (partition by stratum order by score rows between unbounded preceding and 1 preceding), 0) + q / 2) as u from b)
select stratum, sum(p)::bigint as n, sum(q)::bigint as m, round(sum(u) / (sum(p) * sum(q))::double, 6) as auroc from u group by stratum""")
def auroc(spark, sf_dir):  # noqa: ANN001, ANN201
    return scoring.auroc(_scored(spark, sf_dir))


@query(f"""with {_SCORED}, b as (select score, sum(weight * positive) as w, sum(weight * (1 - positive)) as o from s group by score),
r as (select score, sum(w) over (order by score) / (sum(w) over ())::double as kept, 1 - sum(o) over (order by score) / (sum(o) over ())::double as above from b),
x as (select * from r, (select unnest([0.99, 0.95, 0.9]::double[]) as keep) where kept >= keep - 1e-9)
select keep, round(min(score), 6) as cut, round(arg_min(above, score), 6) as rejected from x group by keep""")
def separability_cuts(spark, sf_dir):  # noqa: ANN001, ANN201
    return scoring.quantile_cut(_scored(spark, sf_dir).withColumnRenamed("positive", "inside"), [0.99, 0.95, 0.9])


@query("""with m as (select 'metric ' || p_brand as name, avg(p_retailprice) / 1000 as before, avg(p_retailprice + p_size % 3 - 1) / 1000 as after from part group by 1)
select name, round(before, 9) as before, case when name like '%5' then null else round(after, 9) end as after, case when name like '%5' then 'removed' else 'kept' end as kind, case when name like '%5' then null else round(round(before, 9) - round(after, 9), 9) end as drop,
coalesce(case when name like '%5' then null else round(round(before, 9) - round(after, 9), 12) > 0.00002 end, false) as regressed from m""")
def regression_compare(spark, sf_dir):  # noqa: ANN001, ANN201
    m = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("metric "), "p_brand").alias("name")).agg(F.round(F.avg("p_retailprice") / 1000, 9).alias("before"), F.round(F.avg(F.col("p_retailprice") + F.pmod("p_size", F.lit(3)) - 1) / 1000, 9).alias("after"))
    return scoring.compare_metrics(m.select("name", F.col("before").alias("value")), m.where("name not like '%5'").select("name", F.col("after").alias("value")), m.select("name", F.lit(0.00002).alias("noise")))


@query("""select p_brand as name, round(max(x) - min(x), 6) as noise, count(*) as runs from (select p_brand, p_size % 3 as run, avg(p_retailprice) as x from part group by all) group by p_brand having count(*) = 3""")
def noise_spread(spark, sf_dir):  # noqa: ANN001, ANN201
    """The spread of a score over exactly three runs."""
    runs = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"), F.pmod("p_size", F.lit(3)).alias("run")).agg(F.avg("p_retailprice").alias("x"))
    return runs.groupBy("name").agg(F.round(F.max("x") - F.min("x"), 6).alias("noise"), F.count("*").alias("runs")).where("runs = 3")


@query("""with a as (select s_suppkey, s_name, s_nationkey::varchar as s_nationkey from supplier), b as (select s_suppkey, case when s_suppkey % 7 = 0 then upper(s_name) || '!' else s_name end as s_name, case when s_suppkey % 11 <> 0 then s_nationkey::varchar end as s_nationkey from supplier)
select a.s_suppkey, 's_name' as "column", a.s_name as "left", b.s_name as "right" from a join b using (s_suppkey) where a.s_name is distinct from b.s_name
union all select a.s_suppkey, 's_nationkey', a.s_nationkey, b.s_nationkey from a join b using (s_suppkey) where a.s_nationkey is distinct from b.s_nationkey""")
def table_diff(spark, sf_dir):  # noqa: ANN001, ANN201
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    changed = s.select("s_suppkey", F.when(F.pmod("s_suppkey", F.lit(7)) == 0, F.concat(F.upper("s_name"), F.lit("!"))).otherwise(F.col("s_name")).alias("s_name"), F.when(F.pmod("s_suppkey", F.lit(11)) != 0, F.col("s_nationkey")).alias("s_nationkey"))
    return scoring.table_diff(s, changed, ["s_suppkey"])


@query("""select n_regionkey as tree, sha256(string_agg(n_name || ' ' || sha256(n_name), chr(10) order by n_name || ' ' || sha256(n_name))) as digest from nation group by 1""")
def tree_digest(spark, sf_dir):  # noqa: ANN001, ANN201
    return scoring.tree_digest(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("tree"), F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("blob")))


# --- assignment ----------------------------------------------------------------------------------

def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its place in its order, by all its columns: parts and line numbers repeat."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), rank.cast("long").alias("pos"), "l_partkey", F.col("l_quantity").cast("long").alias("q"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within an order, its lines as billed against its lines as ordered: how alike their
    quantities are, in thousandths, and 1000 more for the same part."""
    l = _lines(spark, sf_dir)  # noqa: E741
    a = l.select("case_id", F.col("pos").alias("left"), F.col("l_partkey").alias("ap"), F.col("q").alias("aq"))
    b = l.select("case_id", F.col("pos").alias("right"), F.col("l_partkey").alias("bp"), (F.col("q") + F.pmod("l_partkey", F.lit(3))).alias("bq"))
    worth = F.when(F.col("ap") == F.col("bp"), 1000).otherwise(0) + normalize.closeness(F.col("aq"), F.col("bq"))
    return a.join(b, "case_id").select("case_id", "left", "right", worth.cast("long").alias("worth")).where("worth >= 900")


@query()
def pair_assignment(spark, sf_dir):  # noqa: ANN001, ANN201
    return assignment.assign(_edges(spark, sf_dir))


@query("""with l as (select l_orderkey as case_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as pos, l_partkey, l_quantity::bigint as q from lineitem),
p as (select a.case_id, a.pos as "left", b.pos as "right", a.l_partkey = b.l_partkey as same, a.q as x, b.q + b.l_partkey % 3 as y from l a join l b using (case_id)),
w as (select case_id, "left", "right", (same::int * 1000 + (2000 * least(x, y) + greatest(x, y)) // (2 * greatest(x, y)))::bigint as worth from p)
select * from w where worth >= 900""")
def pair_candidates(spark, sf_dir):  # noqa: ANN001, ANN201
    return _edges(spark, sf_dir)


def _line_score(l: DataFrame) -> DataFrame:  # noqa: E741
    """Rows of a labelled table (doc, pos, code, q; pos tells a document's rows apart) against a
    reading that drops some rows and misreads some quantities: assigned by how many cells agree,
    right if every cell does; a wrong pair counts as missing and as spurious."""
    k = F.pmod("code", F.lit(10))
    gold = l.select("doc", F.col("pos").alias("left"), F.col("code").alias("gc"), "q")
    guess = l.where(k != 0).select("doc", F.col("pos").alias("right"), F.col("code").alias("rc"), F.when(k == 1, F.col("q") + 100).otherwise(F.col("q")).alias("rq"))
    scale = 100
    code, quantity = F.col("gc") == F.col("rc"), F.col("q") == F.col("rq")
    edges = gold.join(guess, "doc").select("doc", "left", "right", (F.when(code, 2 * scale).otherwise(0) + F.when(quantity, scale).otherwise(0) + F.when(code & quantity, 1).otherwise(0)).cast("long").alias("worth"))
    pairs = assignment.assign(edges.where("worth > 0"), "doc")
    right = pairs.agg(F.count_if(F.col("worth") == 3 * scale + 1).alias("matched"))
    sums = gold.agg(F.count("*").alias("g")).withColumn("_", F.lit(1)).join(guess.agg(F.count("*").alias("s")).withColumn("_", F.lit(1)), "_").join(right.withColumn("_", F.lit(1)), "_")
    return sums.select(F.col("matched"), (F.col("g") - F.col("matched")).alias("missing"), (F.col("s") - F.col("matched")).alias("spurious"))


@query("""with l as (select l_orderkey as doc, l_partkey as code, min(l_quantity) as quantity, count(*) as n from lineitem group by all having count(*) = 1),
x as (select doc, count(*) as rows, count(*) filter (code % 10 <> 0) as paired, count(*) filter (code % 10 not in (0, 1)) as correct from l group by doc)
select sum(correct)::bigint as matched, sum(rows - correct)::bigint as missing, sum(paired - correct)::bigint as spurious from x""")
def line_item_score(spark, sf_dir):  # noqa: ANN001, ANN201
    """The score over the lines whose part comes once in their order, as its SQL has it:
    `line_item_score_all` scores every line."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("code")).agg(F.min("l_quantity").cast("long").alias("q"), F.count("*").alias("n")).where("n = 1")  # noqa: E741
    return _line_score(l.select("doc", F.col("code").alias("pos"), "code", "q"))


@query()
def line_item_score_all(spark, sf_dir):  # noqa: ANN001, ANN201
    """The score over every line, repeated parts included, which only the assignment tells apart."""
    return _line_score(_lines(spark, sf_dir).select(F.col("case_id").alias("doc"), "pos", F.col("l_partkey").alias("code"), "q"))


# --- retrieval -----------------------------------------------------------------------------------

def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("description"))
    return retrieval.catalogue(p)


_CATALOG = """cat as (select 'SKU-' || substr(sha256(description), 1, 8) as sku, description, documents from (select p_name || ' ' || p_type as description, count(distinct p_partkey) as documents from part group by 1) where documents >= 2)"""
_QUERIES = """q as (select p_partkey as qid, substr(p_name, 2) || ' ' || p_type as text from part where p_partkey % 100 = 0)"""
_TRI = """g as (select x.*, list_distinct(flatten(list_transform(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) as grams from (select qid::varchar as id, text, 0 as side from q union all select sku, description, 1 from cat) x),
ge as (select id, side, len(grams) as n, unnest(grams) as gram from g),
tri as (select a.id::bigint as qid, b.id as sku, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*))::double, 6) as score from ge a join ge b on a.gram = b.gram and a.side = 0 and b.side = 1 group by all)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", F.expr("substr(p_name, 2)"), "p_type").alias("text"))


@query(f"with {_CATALOG} select * from cat")
def catalog_build(spark, sf_dir):  # noqa: ANN001, ANN201
    return _entries(spark, sf_dir)


@query(f"with {_CATALOG}, {_QUERIES}, {_TRI} select qid, sku, score, rank from (select *, row_number() over (partition by qid order by score desc, sku)::int as rank from tri) where rank <= 5")
def trigram_top5(spark, sf_dir):  # noqa: ANN001, ANN201
    return retrieval.trigram_arm(_texts(spark, sf_dir), _entries(spark, sf_dir))


@query("""with q as (select vec_id as qid, embedding as v from embeddings where vec_id % 100 = 0),
c as (select qid, vec_id as sku, round(list_cosine_similarity(v::double[], embedding::double[]), 6) as score from q, embeddings)
select qid, sku, score, rank from (select *, row_number() over (partition by qid order by score desc, sku)::int as rank from c) where rank <= 5""")
def vector_top5(spark, sf_dir):  # noqa: ANN001, ANN201
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sku"), F.col("embedding").alias("vector"))
    return retrieval.vector_arm(every.where("sku % 100 = 0").withColumnRenamed("sku", "qid"), every)


@query(f"""with {_CATALOG}, {_QUERIES}, {_TRI}, r1 as (select qid, sku, rank from (select *, row_number() over (partition by qid order by score desc, sku)::int as rank from tri) where rank <= 25),
lev as (select qid, sku, rank from (select qid, sku, row_number() over (partition by qid order by round(1 - levenshtein(text, description) / greatest(length(text), length(description))::double, 6) desc, sku)::int as rank from tri join q using (qid) join cat using (sku)) where rank <= 25),
f as (select qid, sku, round(sum(1 / (60 + rank)::double), 9) as score from (select * from r1 union all select * from lev) group by all)
select qid, sku, score, rank from (select *, row_number() over (partition by qid order by score desc, sku)::int as rank from f) where rank <= 5""")
def hybrid_rrf(spark, sf_dir):  # noqa: ANN001, ANN201
    """Two ranked halves - by trigrams, and the same candidates by edit similarity - fused."""
    texts, entries = _texts(spark, sf_dir), _entries(spark, sf_dir)
    every = retrieval.trigram_arm(texts, entries, depth=10**9)
    alike = F.round(normalize.similarity(F.col("text"), F.col("description")), 6)
    second = retrieval.ranked(every.select("qid", "sku").join(texts, "qid").join(entries, "sku").select("qid", "sku", alike.alias("score")), 25)
    return retrieval.fuse(every.where("rank <= 25"), second)


@query(f"""with {_CATALOG}, t as (select p_partkey as qid, case when p_partkey % 2 = 0 then substr(p_name || ' ' || p_type, 3) else p_name || ' ' || p_type || 's' end as text from part)
select qid, text from t where not exists (select 1 from cat where 1 - levenshtein(text, description) / greatest(length(text), length(description))::double >= 0.95 - 1e-9)""")
def catalog_guard(spark, sf_dir):  # noqa: ANN001, ANN201
    d = F.concat_ws(" ", "p_name", "p_type")
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, d.substr(F.lit(3), F.length(d))).otherwise(F.concat(d, F.lit("s"))).alias("text"))
    return retrieval.unlike(t, _entries(spark, sf_dir))


@query(f"""with {_CATALOG}, w as (select *, string_split(description, ' ') as words from cat), m as (select *, list_max(list_transform(words, lambda w: length(w))) as longest from w)
select sku, description, case when len(list_filter(words, lambda w: length(w) < longest)) > 0 then array_to_string(list_filter(words, lambda w: length(w) < longest), ' ') end as shortened from m""")
def query_noise(spark, sf_dir):  # noqa: ANN001, ANN201
    """Descriptions with their longest words dropped, one kind of noise a query may carry."""
    words = F.split("description", " ")
    longest = F.array_max(F.transform(words, lambda w: F.length(w)))
    short = F.filter(words, lambda w: F.length(w) < longest)
    return _entries(spark, sf_dir).select("sku", "description", F.when(F.size(short) > 0, F.array_join(short, " ")).alias("shortened"))


@query("""select o_orderkey, row_number() over (order by sha256('17:' || o_orderkey::varchar), o_orderkey)::int as place from orders qualify place <= 100""")
def seeded_ranking(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first hundred documents in an order fixed by a seed: a top-k report."""
    digest = F.sha2(F.concat(F.lit("17:"), F.col("o_orderkey").cast("string")), 256)
    from pyspark.sql import Window as W

    top = table(spark, sf_dir, "orders").select("o_orderkey", digest.alias("d")).orderBy("d", "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(W.orderBy("d", "o_orderkey")).alias("place"))


# --- logs ----------------------------------------------------------------------------------------

@query("""with w as (select event_type, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) as wait from events)
select event_type, count(wait) as n, round(quantile_disc(wait, 0.5), 3) as p50, round(quantile_disc(wait, 0.95), 3) as p95 from w where wait is not null group by event_type""")
def status_wait(spark, sf_dir):  # noqa: ANN001, ANN201
    w = logs.waits(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"]).where("wait is not null")
    return w.groupBy("event_type").agg(F.count("wait").alias("n"), F.round(scoring.nearest_rank("wait", 50), 3).alias("p50"), F.round(scoring.nearest_rank("wait", 95), 3).alias("p95"))


@query("""with s as (select user_id, min(ts) as s from events where event_type = 'view' group by 1)
select user_id, round(epoch(min(ts)) - epoch(any_value(s)), 3) as seconds from events join s using (user_id) where event_type = 'purchase' and ts >= s group by user_id""")
def end_to_end_latency(spark, sf_dir):  # noqa: ANN001, ANN201
    found = logs.first_between(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "view", F.col("event_type") == "purchase")
    return found.select("user_id", F.round("seconds", 3).alias("seconds"))


@query("""select user_id, arg_max(event_type, event_id) as event_type, arg_max(props, event_id) as props from events group by user_id""")
def latest_state(spark, sf_dir):  # noqa: ANN001, ANN201
    return logs.latest_of(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "props")


@query("""with e as (select user_id as doc, event_id % 5 as place, event_id as seq, event_id % 4 as value, 1 as read from events)
select * from (select doc, place, arg_max(value, seq) as value, any_value(read) as read, count(*) as edits from e group by all) where value is distinct from read""")
def edit_fold(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.pmod("event_id", F.lit(5)).alias("place"), F.col("event_id").alias("seq"), F.pmod("event_id", F.lit(4)).alias("value"), F.lit(1).alias("read"))
    return logs.fold(e, ["doc", "place"], "seq")


@query("""with d as (select doc_id as id, md5(text) as digest, row_number() over (partition by md5(text) order by doc_id) as n from documents where text is not null)
select id, digest from d where n = 1 and digest not in (select md5(text) from documents where source = 'archive_copy' and text is not null)""")
def digest_dedup(spark, sf_dir):  # noqa: ANN001, ANN201
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"), "source")
    return logs.new_only(d, d.where("source = 'archive_copy'")).select("id", "digest")


@query("""with r as (select c_nationkey as k, min(o_orderdate) + (i * interval 200 day) as since, (c_nationkey + i) % 7 as rate from orders join customer on o_custkey = c_custkey, range(0, 5) t(i) group by c_nationkey, i),
o as (select o_orderkey, c_nationkey as k, o_orderdate as at from orders join customer on o_custkey = c_custkey)
select o_orderkey, o.k, rate from o asof left join r on o.k = r.k and o.at >= r.since""")
def rate_asof(spark, sf_dir):  # noqa: ANN001, ANN201
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("k"), F.col("o_orderdate").alias("at"))
    i = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")
    rates = o.groupBy("k").agg(F.min("at").alias("first")).select("k", "first", i).select("k", (F.col("first") + F.make_dt_interval(F.col("i") * 200)).alias("since"), F.pmod(F.col("k") + F.col("i"), F.lit(7)).alias("rate"))
    return logs.as_of(o, rates, "k", "at", "since", "rate").select("o_orderkey", "k", "rate")


@query("""select o_orderkey, coalesce(n_lines, 0)::bigint as n_lines, coalesce(quantity, 0) as quantity, coalesce(returned, 0)::bigint as returned from orders left join (select l_orderkey, count(*) as n_lines, sum(l_quantity) as quantity, count(*) filter (l_returnflag = 'R') as returned from lineitem group by 1) on o_orderkey = l_orderkey""")
def ledger(spark, sf_dir):  # noqa: ANN001, ANN201
    """One row a document, with what its lines add up to; documents without lines stay."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))  # noqa: E741
    return table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "quantity", "returned")])


@query("""select o_orderkey, strftime(o_orderdate, '%Y%m') as period, o_totalprice as total from orders""")
def xml_read(spark, sf_dir):  # noqa: ANN001, ANN201
    """Comprobantes written as XML and read back by path."""
    o = table(spark, sf_dir, "orders")
    doc = F.format_string("<ECF><Encabezado><IdDoc><Id>%d</Id><Periodo>%s</Periodo></IdDoc><Totales><MontoTotal>%s</MontoTotal></Totales></Encabezado></ECF>", "o_orderkey", F.date_format("o_orderdate", "yyyyMM"), F.col("o_totalprice").cast("string"))
    x = o.select(doc.alias("x"))
    at = lambda path: F.xpath_string("x", F.lit(path))
    return x.select(at("/ECF/Encabezado/IdDoc/Id").cast("long").alias("o_orderkey"), at("//Periodo").alias("period"), at("//MontoTotal").cast("double").alias("total"))


@query("""select (ts::date)::varchar as day, event_type, count(*) as n, count(distinct user_id) as users from events group by all""")
def events_by_day(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


# --- streams -------------------------------------------------------------------------------------

@query("""select (ts::date)::varchar as day, event_type, count(*) as n from events group by all""")
def stream_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    counts = streams.windowed_counts(streams.arriving(spark, sf_dir, "events"), "ts", "event_type")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""select user_id, arg_max(event_type, event_id) as event_type from events group by user_id""")
def stream_last_state(spark, sf_dir):  # noqa: ANN001, ANN201
    return streams.last_states(streams.arriving(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""select props as digest, min(event_id) as event_id from events where props is not null group by props""")
def stream_first_seen(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = streams.arriving(spark, sf_dir, "events").where("props is not null").select(F.col("props").alias("digest"), "event_id")
    return streams.first_seen(rows, "digest", "event_id")


# --- more checks and tables ----------------------------------------------------------------------

@query("""with x as (select c_custkey, lpad((c_custkey * 7919 % 1000000000)::varchar, 9, '0') as id from customer),
w as (select *, (id[1]::int * 7 + id[2]::int * 9 + id[3]::int * 8 + id[4]::int * 6 + id[5]::int * 5 + id[6]::int * 4 + id[7]::int * 3 + id[8]::int * 2) % 11 as r from x)
select c_custkey, id, id[9]::int = (10 - r) % 9 + 1 as valid from w""")
def identifier_check(spark, sf_dir):  # noqa: ANN001, ANN201
    ids = table(spark, sf_dir, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 7919 % 1_000_000_000).cast("string"), 9, "0").alias("id"))
    return ids.withColumn("valid", identifiers.taxpayer(F.col("id")))


@query("""with t as (select l_orderkey as doc, l_linenumber as line, l_returnflag as kind from lineitem where l_partkey % 5 = 0), f as (select l_orderkey as doc, l_linenumber as line, l_returnflag as kind from lineitem where l_partkey % 10 in (0, 3)),
k as (select distinct l_returnflag as kind from lineitem union select 'none'), td as (select distinct * from t), fd as (select distinct * from f),
b as (select coalesce(td.kind, fd.kind) as kind, td.doc is not null as t, fd.doc is not null as f from td full join fd on td.doc = fd.doc and td.line = fd.line and td.kind = fd.kind)
select k.kind, count(*) filter (t and f) as hits, count(*) filter (t and not f) as misses, count(*) filter (f and not t) as false_alarms from k left join b on k.kind = b.kind group by k.kind""")
def finding_score(spark, sf_dir):  # noqa: ANN001, ANN201
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    cols = [F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("kind")]
    kinds = l.select(F.col("l_returnflag").alias("kind")).distinct().unionByName(spark.sql("select 'none' as kind"))
    return scoring.found_against_truth(l.where("l_partkey % 10 in (0, 3)").select(cols), l.where("l_partkey % 5 = 0").select(cols), ["doc", "line"], "kind", kinds)


@query("""with s as (select l_linenumber as setting, round(avg((l_quantity > 20)::int), 6) as score from lineitem group by 1), b as (select max(score) as best from s)
select min(setting) as setting from s, b where score >= best - 0.01""")
def depth_sweep(spark, sf_dir):  # noqa: ANN001, ANN201
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("setting")).agg(F.round(F.avg((F.col("l_quantity") > 20).cast("int")), 6).alias("score"))
    return scoring.choose_depth(points)


@query("""with r as (select p_brand as arm, avg(case when p_size % 2 = 0 then (p_retailprice > 1000)::int end) as e, avg(case when p_size % 2 = 1 then (p_retailprice > 1000)::int end) as n from part group by 1)
select arm, round(coalesce(2 / 3::double * e + (1 - 2 / 3::double) * n, e, n), 6) as headline from r""")
def resolve_headline(spark, sf_dir):  # noqa: ANN001, ANN201
    hit = (F.col("p_retailprice") > 1000).cast("int")
    rates = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("arm")).agg(F.avg(F.when(F.col("p_size") % 2 == 0, hit)).alias("e"), F.avg(F.when(F.col("p_size") % 2 == 1, hit)).alias("n"))
    return rates.select("arm", F.round(scoring.headline(F.col("e"), F.col("n")), 6).alias("headline"))


@query("""with d as (select *, row_number() over (partition by run_row_id order by loaded_at desc) as r from run_documents)
select backend, count(*) as documents, count(*) filter (predicted) as predicted, sum(cost)::double as cost, quantile_disc(case when predicted and latency >= 0 and not isnan(latency) and not isinf(latency) then latency end, 0.5) as p50,
quantile_disc(case when predicted and latency >= 0 and not isnan(latency) and not isinf(latency) then latency end, 0.95) as p95 from d where r = 1 group by backend""")
def run_totals(spark, sf_dir):  # noqa: ANN001, ANN201
    """Cost over all documents of a backend, latency over those with a prediction."""
    d = latest(table(spark, sf_dir, "run_documents").select("run_row_id", "backend", "predicted", "cost", "latency", "loaded_at"), "run_row_id")
    usable = F.when(F.col("predicted") & (F.col("latency") >= 0) & ~F.isnan("latency") & (F.col("latency") != float("inf")), F.col("latency"))
    return d.withColumn("usable", usable).groupBy("backend").agg(
        F.count("*").alias("documents"), F.count_if("predicted").alias("predicted"), F.sum("cost").cast("double").alias("cost"), scoring.nearest_rank("usable", 50).alias("p50"), scoring.nearest_rank("usable", 95).alias("p95")
    )


@query("""with c as (select *, row_number() over (partition by correction_id order by loaded_at desc) as r from corrections) select decision, count(*) as records, count(distinct document) as documents from c where r = 1 group by decision""")
def corrections_by_decision(spark, sf_dir):  # noqa: ANN001, ANN201
    c = latest(table(spark, sf_dir, "corrections").select("correction_id", "document", "decision", "loaded_at"), "correction_id")
    return c.groupBy("decision").agg(F.count("*").alias("records"), F.countDistinct("document").alias("documents"))
