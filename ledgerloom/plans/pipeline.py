"""Queries of edits, the monthly export, the document loop and resolution, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import edits, export, loop, resolution, retrieval
from ledgerloom.plans.cases import _MONEY, money
from ledgerloom.plans.reference import _CATALOG, _QUERIES, _TRI, _entries, _texts
from ledgerloom.plans.registry import filled, registry
from ledgerloom.session import latest, table

QUERIES, ORACLES, query = registry()


# --- edits ---------------------------------------------------------------------------------------

def edit_log(spark: SparkSession, sf_dir: str, removes: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edits of readings of three lines each, every value read as 1."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "header").when(F.col("event_type") == "purchase", "line added").when((F.col("event_type") == "error") & F.lit(removes), "line removed").otherwise("cell")
    log = e.select(F.col("user_id").alias("doc"), i.alias("seq"), kind.alias("kind"), F.pmod(i, F.lit(4)).cast("long").alias("line"), F.concat(F.lit("f"), F.pmod(i, F.lit(3)).cast("string")).alias("fieldtype"), F.when(F.pmod(i, F.lit(5)) == 0, " ").otherwise(F.pmod(i, F.lit(5)).cast("string")).alias("value"))
    docs = e.select(F.col("user_id").alias("doc")).distinct()
    one = F.array(F.lit("1"))
    header = docs.select("doc", F.explode(F.array(F.lit("f0"), F.lit("f1"))).alias("fieldtype"), one.alias("texts"))
    cells = docs.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("line")).select("doc", "line", F.explode(F.array(F.lit("f0"), F.lit("f1"))).alias("fieldtype"), one.alias("texts"))
    return log, header, cells, docs.select("doc", F.lit(4).cast("long").alias("lines"))


_EDITS = """e as (select user_id as doc, event_id as seq, event_type, event_id % 4 as line, 'f' || (event_id % 3)::varchar as fieldtype, case when event_id % 5 = 0 then '' else (event_id % 5)::varchar end as value from events)"""


@query(f"""with {_EDITS}, h as (select doc, 'header' as kind, null::bigint as line, fieldtype, arg_max(value, seq) as value from e where event_type = 'view' group by doc, fieldtype
union all select doc, 'cell', line, fieldtype, arg_max(value, seq) from e where event_type not in ('view', 'purchase') group by doc, line, fieldtype)
select doc, kind, line, fieldtype, case when fieldtype = 'f2' then '' else '1' end as read, value as "left" from h where value <> case when fieldtype = 'f2' then '' else '1' end""")
def corrections_fold(spark, sf_dir):  # noqa: ANN001, ANN201
    net = edits.corrections(*edit_log(spark, sf_dir, False))
    return net.select("doc", "kind", "line", "fieldtype", F.array_join("read", "|").alias("read"), F.array_join("left", "|").alias("left"))


@query(f"""with {_EDITS}, r as (select doc, line, min(seq) as first from e where event_type = 'error' group by all),
x as (select e.doc, e.seq, 'line ' || e.line::varchar || ' is removed' as error from e join r using (doc, line) where e.seq > first and event_type not in ('view', 'purchase'))
select doc, min(seq) as seq, arg_min(error, seq) as error from x group by doc""")
def illegal_edits(spark, sf_dir):  # noqa: ANN001, ANN201
    log, _, _, counts = edit_log(spark, sf_dir, True)
    return edits.illegal(log, counts)


@query(f"""with {_EDITS}, h as (select doc, 'header' as part, fieldtype as name, arg_max(value, seq) as value from e where event_type = 'view' group by doc, fieldtype union all select doc, 'cell', fieldtype, value from (select doc, line, fieldtype, arg_max(value, seq) as value from e where event_type not in ('view', 'purchase') group by doc, line, fieldtype)),
n as (select *, case when name = 'f2' then '' else '1' end as read from h)
select part, name, count(*) as corrections, count(*) filter (value = '2' and name <> 'f2' or value = '' and name = 'f2') as read_right, count(*) filter (value = '') as label_agrees from n where value <> read group by all""")
def corrections_tally(spark, sf_dir):  # noqa: ANN001, ANN201
    """The net corrections judged against a run that reads every value as 2 and labels that have none."""
    log, header, cells, counts = edit_log(spark, sf_dir, False)
    run = header.select("doc", F.lit(None).cast("long").alias("line"), "fieldtype", F.array(F.lit("2")).alias("texts")).unionByName(cells.select("doc", "line", "fieldtype", F.array(F.lit("2.0")).alias("texts")))
    return edits.tallies(edits.corrections(log, header, cells, counts), run, run.where("false"))


# --- monthly export ------------------------------------------------------------------------------

REPORTER = "131793916"


def filing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents' values and the taxpayer's choices: some without number, taxpayer, date or reading."""
    o, k = table(spark, sf_dir, "orders"), F.pmod("o_orderkey", F.lit(13))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    base = F.lpad(F.pmod("o_custkey", F.lit(100_000_000)).cast("string"), 8, "0")
    weighed = sum(base.substr(i + 1, 1).cast("int") * w for i, w in enumerate((7, 9, 8, 6, 5, 4, 3, 2)))
    rnc = F.concat(base, (F.pmod(10 - F.pmod(weighed, F.lit(11)), F.lit(9)) + 1).cast("string"))
    number = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    entry = lambda n, c: F.when(c.isNotNull(), F.struct(F.lit(n).alias("k"), F.array(c).alias("v")))
    values = F.map_from_entries(F.array_compact(F.array(
        entry("document_id", F.when(k == 4, F.concat(F.lit("B02"), number)).when(k != 1, F.concat(F.lit("B01"), number))), entry("vendor_tax_id", F.when(k == 2, F.lit("12")).otherwise(rnc)), entry("customer_tax_id", F.when(k == 8, F.lit("101000000")).otherwise(F.lit(f"{REPORTER[:3]}-{REPORTER[3:]}"))),
        entry("date_issue", F.when(k == 3, F.lit("soon")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))), entry("amount_total_net", F.concat(F.when(k == 7, "-").otherwise(""), money(cents))), entry("amount_total_tax", F.when(k != 9, money(F.floor(cents * 18 / 100).cast("long")))), entry("amount_tip", F.when(k == 10, F.lit("ten"))),
    )))
    doc = F.col("o_orderkey").alias("doc")
    read = o.select(doc, F.when(k != 6, values).alias("values"))
    sheet = o.select(
        doc, F.when(k == 11, "no").otherwise("yes").alias("reported"), F.lit("9").alias("purchase_type"), F.when(k == 5, "services").otherwise("goods").alias("split"), F.lit("").alias("payment_date"), F.lit("4").alias("payment_method"),
        F.lit("").alias("itbis_proportional"), F.when(k == 12, "all").otherwise("").alias("itbis_to_cost"), F.when(k == 5, "1").otherwise("").alias("isr_retention_type"),
    )
    return read, sheet


_FILED = f"""d as (select o_orderkey as doc, o_orderkey % 13 as k, round(o_totalprice * 100)::bigint as c, lpad((o_custkey % 100000000)::varchar, 8, '0') as b, lpad(o_orderkey::varchar, 8, '0') as n, o_orderdate from orders where o_orderkey % 13 <> 11),
r as (select *, case when k = 9 then 0 else c * 18 // 100 end as t, b || ((10 - (b[1]::int * 7 + b[2]::int * 9 + b[3]::int * 8 + b[4]::int * 6 + b[5]::int * 5 + b[6]::int * 4 + b[7]::int * 3 + b[8]::int * 2) % 11) % 9 + 1)::varchar as rnc from d),
x as (select *, k = 4 and c + t <= 25000000 as small, case k when 1 then 'no NCF' when 2 then 'RNC or cedula invalid' when 3 then 'date unreadable' when 6 then 'no reading' when 7 then 'amount_total_net negative' when 8 then 'buyer is not the reporter' when 10 then 'amount_tip unreadable' else '' end as reason from r),
y as (select doc, case when k in (3, 6) then 'no month' else strftime(o_orderdate, '%Y%m') end as period, reason, small, case when reason = '' and not small then rnc || '|1|09|' || case when k = 4 then 'B02' else 'B01' end || n || '||' || strftime(o_orderdate, '%Y%m%d') || '||' ||
  case when k = 5 then {_MONEY.format('c')} else '0.00' end || '|' || case when k = 5 then '0.00' else {_MONEY.format('c')} end || '|' || {_MONEY.format('c')} || '|' || {_MONEY.format('t')} || '|0.00|0.00|' || case when k = 12 then {_MONEY.format('t')} else '0.00' end || '|' ||
  case when k = 12 then '0.00' else {_MONEY.format('t')} end || '|0.00|' || case when k = 5 then '01' else '' end || '|' || case when k = 5 then {_MONEY.format('((c * 10 + 50) // 100)')} else '0.00' end || '|0.00|0.00|0.00|0.00|4' end as line from x)"""


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    read, sheet = filing(spark, sf_dir)
    return export.outcomes(export.choices(sheet).join(read, "doc", "left"), REPORTER)


@query(f"with {_FILED} select doc, period, line, reason as reasons, case when small then 'consumo of RD$250,000.00 or less' end as left_out from y")
def monthly_export(spark, sf_dir):  # noqa: ANN001, ANN201
    return exported(spark, sf_dir).select("doc", "period", "line", F.array_join("reasons", "; ").alias("reasons"), "left_out")


@query(f"with {_FILED} select period, count(line) as lines, count(*) filter (reason <> '') as failures, bool_or(reason <> '') as failed from y where not small group by period")
def export_months(spark, sf_dir):  # noqa: ANN001, ANN201
    return export.months(exported(spark, sf_dir))


@query(f"with {_FILED} select period, reason, count(*) as n from y where reason <> '' group by all")
def export_reasons(spark, sf_dir):  # noqa: ANN001, ANN201
    return export.reasons_by_month(exported(spark, sf_dir))


@query(f"with {_FILED} select side, count(*) as documents, count(line) as lines from y, (select unnest(['reading', 'control']) as side) group by side")
def export_sides(spark, sf_dir):  # noqa: ANN001, ANN201
    """What was read and, as control, the labels (here the same), filed side by side."""
    read, sheet = filing(spark, sf_dir)
    return export.sides(read, read, export.choices(sheet), REPORTER).groupBy("side").agg(F.count("*").alias("documents"), F.count("line").alias("lines"))


@query("""select o_orderkey as doc, o_orderkey % 9 <> 0 as reported, case o_orderkey % 9 when 1 then 'purchase_type is 12' when 2 then 'split is both' when 3 then 'payment_date is 2026-02-30' when 4 then 'itbis_to_cost is 1.234' when 5 then 'isr_retention_type is 10' end as error from orders""")
def filing_choices(spark, sf_dir):  # noqa: ANN001, ANN201
    """Choices read from a sheet, with the first that is not allowed."""
    k = F.pmod("o_orderkey", F.lit(9))
    at = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    sheet = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc"), at(0, "No", "yes").alias("reported"), at(1, "12", " 9 ").alias("purchase_type"), at(2, "both", "12.50").alias("split"), at(3, "2026-02-30", "2026-02-28").alias("payment_date"), F.lit("1").alias("payment_method"),
        F.lit("all").alias("itbis_proportional"), at(4, "1.234", "").alias("itbis_to_cost"), at(5, "10", "").alias("isr_retention_type"),
    )
    return export.choices(sheet).select("doc", "reported", "error")


# --- the loop ------------------------------------------------------------------------------------

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("received", "extracted", "validated", "resolved", "matched", "approved", "needs_review"))), F.pmod(k, F.lit(7)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), status.alias("status"), F.when(k % 3 == 0, F.expr("timestamp'2026-01-01 00:00:00'")).when(k % 3 == 1, F.expr("timestamp'2026-01-03 00:00:00'")).alias("lease_until"), F.lit(None).cast("timestamp").alias("taken_at"),
        F.create_map(status, F.pmod(k, F.lit(5)).cast("int")).alias("lapses"),
    )


_DOCS = """d as (select o_orderkey as id, ['received', 'extracted', 'validated', 'resolved', 'matched', 'approved', 'needs_review'][(o_orderkey % 7 + 1)::int] as status, o_orderkey % 3 as l, o_orderkey % 5 as lapses from orders),
c as (select *, lapses + (l = 0)::int as now_lapses from d where status not in ('approved', 'needs_review') and l <> 1 order by id limit 40),
m as (select id, status as from_status, case when now_lapses >= 3 or status = 'received' and id % 11 = 0 or status = 'matched' and id % 2 = 0 then 'needs_review' else case status when 'received' then 'extracted' when 'extracted' then 'validated' when 'validated' then 'resolved' when 'resolved' then 'matched' else 'approved' end end as to_status,
  case when now_lapses >= 3 then case when id % 2 = 0 then 'gate failed|' else '' end || 'pipeline failed at ' || status when status = 'received' and id % 11 = 0 then 'extraction failed' when status = 'matched' and id % 2 = 0 then 'gate failed' else '' end as reasons from c)"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = loop.claim(documents(spark, sf_dir), F.expr("timestamp'2026-01-02 00:00:00'"), 40)
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 11 != 0).alias("extracted"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("gate failed"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return loop.move(claimed, known)


@query(f"with {_DOCS} select id, status, now_lapses as lapses from c")
def claims(spark, sf_dir):  # noqa: ANN001, ANN201
    """The forty oldest pending documents whose lease is free, with their lapses: a top-k of the queue."""
    claimed = loop.claim(documents(spark, sf_dir), F.expr("timestamp'2026-01-02 00:00:00'"), 40)
    return claimed.select("id", "status", F.col("lapses")[F.col("status")].alias("lapses"))


@query(f"with {_DOCS} select * from m")
def transitions(spark, sf_dir):  # noqa: ANN001, ANN201
    return _moves(spark, sf_dir).select("id", "from_status", "to_status", F.array_join("reasons", "|").alias("reasons"))


@query(f"with {_DOCS} select coalesce(to_status, status) as status, count(*) as n from d left join m using (id) group by 1")
def committed_statuses(spark, sf_dir):  # noqa: ANN001, ANN201
    """The queue after the moves, each made only where its document still stands; moves made twice count once."""
    moves = _moves(spark, sf_dir)
    after, _ = loop.commit(documents(spark, sf_dir), moves.unionByName(moves))
    return after.groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {_DOCS} select d.id, d.status from d where id % 4 = 0 and status <> 'needs_review'")
def refused_decisions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Decisions on documents that are not in review."""
    docs = documents(spark, sf_dir)
    _, refused = loop.decide(docs, docs.where("id % 4 = 0").select("id", F.lit("approved").alias("to_status"), F.expr("timestamp'2026-01-02 00:00:00'").alias("taken_at")))
    return refused.select("id").join(docs.select("id", "status"), "id")


@query(f"with {_DOCS} select id, status from d where status = 'needs_review'")
def review_queue(spark, sf_dir):  # noqa: ANN001, ANN201
    return loop.queue(documents(spark, sf_dir), "needs_review").select("id", "status")


@query("""with d as (select *, row_number() over (partition by run_row_id order by loaded_at desc) as r from run_documents),
n as (select run_row_id, coalesce(input_tokens, 0) as i, coalesce(output_tokens, 0) as o, coalesce(output_tokens, 0) // 2 as c, coalesce(pages, 0) as p from d where r = 1)
select run_row_id, (((i - c) * 30 + c * 3 + o * 250 + p * 150000 + 50) // 100) / 1000000.0::double as price from n""")
def model_price(spark, sf_dir):  # noqa: ANN001, ANN201
    """Each document of a run at a list price, half as many tokens cached as were written."""
    d = latest(table(spark, sf_dir, "run_documents").select("run_row_id", "input_tokens", "output_tokens", "pages", "loaded_at"), "run_row_id")
    cached = F.floor(F.coalesce("output_tokens", F.lit(0)) / 2)
    cost = loop.price({"input": F.col("input_tokens"), "cached": cached, "output": F.col("output_tokens"), "pages": F.col("pages")}, {"input": "0.3", "cached": "0.03", "output": "2.5", "pages": "1.5"})
    return d.select("run_row_id", F.round(cost, 6).cast("double").alias("price"))


@query("""with t as (select user_id as document, event_id as id, ts as taken_at, ts + to_seconds(event_id % 50) as committed_at from events)
select document, id, round(epoch(taken_at) - lag(epoch(committed_at)) over (partition by document order by id), 3) as wait, round(epoch(committed_at) - epoch(taken_at), 3) as work from t""")
def transition_work(spark, sf_dir):  # noqa: ANN001, ANN201
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("document"), F.col("event_id").alias("id"), F.col("ts").alias("taken_at"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod("event_id", F.lit(50)))).alias("committed_at"))
    return loop.works(log).select("document", "id", F.round("wait", 3).alias("wait"), F.round("work", 3).alias("work"))


@query("""select user_id as document, event_id as id, row_number() over (partition by user_id order by event_id)::int as step, event_type as status, round(epoch(ts) - first(epoch(ts)) over (partition by user_id order by event_id), 3) as after from events""")
def document_trace(spark, sf_dir):  # noqa: ANN001, ANN201
    return loop.trace(table(spark, sf_dir, "events").select(F.col("user_id").alias("document"), F.col("event_id").alias("id"), F.col("event_type").alias("to_status"), F.col("ts").alias("committed_at")))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls numbered within five of a user's events: some succeed, some fail for good."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(
        (F.col("user_id") * 100_000 + F.floor(n / 5)).alias("document"), (F.pmod(n, F.lit(5)) + 1).alias("number"), (F.pmod(i, F.lit(4)) / 50).cast("decimal(10,6)").alias("cost"), F.when(i % 3 != 0, F.concat(F.lit("error "), i.cast("string"))).alias("error"),
        F.when(i % 7 == 1, 400).when(i % 7 == 2, 429).when(i % 7 == 3, 503).alias("status_code"),
    )


@query("""with e as (select *, row_number() over (partition by user_id order by event_id) - 1 as n from events),
a as (select user_id * 100000 + n // 5 as document, n % 5 + 1 as number, (event_id % 4) / 50.0::double as cost, event_id % 3 <> 0 as failed, event_id % 7 = 1 and event_id % 3 <> 0 as final, event_id from e),
b as (select *, coalesce(bool_or(not failed or final) over w, false) or number > 3 or coalesce(sum(cost) over w, 0) >= 0.05 - 1e-9 and number > 1 as out from a window w as (partition by document order by number rows between unbounded preceding and 1 preceding)),
c as (select *, bool_or(out) over (partition by document order by number) as gone from b)
select document, count(*) as attempts, round(sum(cost), 6) as cost, arg_max(case when failed then 'error ' || event_id::varchar else '' end, number) as failure, sum(case when number > 1 then 2.0 * 2 ** (number - 2) else 0 end) as waited from c where not gone group by document""")
def retried_calls(spark, sf_dir):  # noqa: ANN001, ANN201
    out = loop.retried(attempts(spark, sf_dir))
    last = F.coalesce("failure", F.lit(""))
    return out.select("document", "attempts", F.col("cost").cast("double").alias("cost"), last.alias("failure"), "waited")


# --- resolution ----------------------------------------------------------------------------------

@query(f"""with {_CATALOG}, {_QUERIES}, {_TRI}, s as (select qid, score, row_number() over (partition by qid order by score desc, sku) as rank from tri), p as (select qid, count(*) as n, max(score) filter (rank = 5) as c, max(score) filter (rank = 25) as f, max(score) filter (rank = 1) as a, max(score) filter (rank = 2) as b from s where rank <= 25 group by qid)
select qid, case when n < 25 then 'short' when c = f then 'equal' else 'distinct' end as outcome, coalesce(a = b, false) as tied from p""")
def over_fetch(spark, sf_dir):  # noqa: ANN001, ANN201
    return resolution.over_fetch(retrieval.trigram_arm(_texts(spark, sf_dir), _entries(spark, sf_dir), depth=25))


@query(f"""with {_CATALOG}, {_QUERIES}, {_TRI}, s as (select qid, sku, row_number() over (partition by qid order by score desc, sku) as rank from tri), t as (select p_partkey as qid, 'SKU-' || substr(sha256(p_name || ' ' || p_type), 1, 8) as sku, case when p_partkey % 200 = 0 then 'exact' else 'punctuation' end as kind from part where p_partkey % 100 = 0)
select k.kind, count(t.qid) as n, count(*) filter (rank = 1) as top1, count(*) filter (rank <= 5) as top5 from (select unnest(['exact', 'extra words', 'letters substituted', 'digits dropped', 'punctuation']) as kind) k left join t using (kind) left join s on s.qid = t.qid and s.sku = t.sku group by k.kind""")
def top_by_kind(spark, sf_dir):  # noqa: ANN001, ANN201
    p = table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    asked = p.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("SKU-"), F.substring(F.sha2(F.concat_ws(" ", "p_name", "p_type"), 256), 1, 8)).alias("sku"), F.when(F.col("p_partkey") % 200 == 0, "exact").otherwise("punctuation").alias("kind"))
    return resolution.by_kind(asked, retrieval.trigram_arm(_texts(spark, sf_dir), _entries(spark, sf_dir)))


@query()
def query_set(spark, sf_dir):  # noqa: ANN001, ANN201
    """Exact and noisy queries of every catalogue entry, drawn by hash."""
    return resolution.query_set(_entries(spark, sf_dir), 17)


@query()
def query_kind_shares(spark, sf_dir):  # noqa: ANN001, ANN201
    return resolution.kind_shares(resolution.query_set(_entries(spark, sf_dir), 17))


@query()
def query_band_shares(spark, sf_dir):  # noqa: ANN001, ANN201
    entries = _entries(spark, sf_dir)
    return resolution.band_shares(resolution.query_set(entries, 17), entries)


@query()
def pairing_floor(spark, sf_dir):  # noqa: ANN001, ANN201
    """The floor that at most one in a hundred of ten thousand drawn unrelated pairs of descriptions reach: a measurement by draw."""
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return resolution.floor(lines, 10_000, 17)


filled(QUERIES, ORACLES, "corrections_fold", "line")
