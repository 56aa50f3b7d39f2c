"""The monthly purchase report: one fixed 23-field line a comprobante, by month, or why it has none.

Rows come one a document: doc, values (a map of fieldtype to printed texts, null where it was not
read) and the taxpayer's choices (see `choices`). A month with any failure fails whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import identifiers, normalize

# Amounts a line reads, types of comprobante, the retention rates with the first day each applies on, and codes allowed.
AMOUNTS = ("amount_total_net", "amount_total_tax", "amount_retention_itbis", "amount_retention_isr", "amount_tax_selective", "amount_tax_other", "amount_tip")
CONSUMO, SMALL_EXPENSES, NOTES = ("B02", "E32"), ("B13", "E43"), ("B03", "B04", "E33", "E34")
CONSUMO_MOST = "250000.00"
RATES = {1: (("0001-01-01", "0.10"), ("2026-07-01", "0.15")), 2: (("0001-01-01", "0.10"), ("2026-07-01", "0.15"))}
CODES = {"purchase_type": 11, "payment_method": 7, "isr_retention_type": 9}
NO_MONTH = "no month"
MONEY = "decimal(28,8)"


def choices(rows: DataFrame) -> DataFrame:
    """A filing sheet's text columns read: reported, purchase_type, split (services, goods or a sum),
    payment_date, payment_method, itbis_proportional, itbis_to_cost, isr_retention_type; `error` tells
    the first choice that is not allowed. Of a document not reported nothing else is read."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    amount = lambda c: text(c).rlike(r"^\d+(\.\d{1,2})?$")
    code = lambda c: text(c).rlike(r"^\d{1,2}$") & text(c).try_cast("int").between(1, CODES[c])
    share = lambda c: (text(c) == "") | (text(c) == "all") | amount(c)
    yes = F.lower(text("reported")) == "yes"
    bad = lambda c: F.concat(F.lit(f"{c} is "), text(c))
    error = (
        F.when(~F.lower(text("reported")).isin("yes", "no"), bad("reported")).when(~yes, None).when(~code("purchase_type"), bad("purchase_type")).when(~(text("split").isin("services", "goods") | amount("split")), bad("split"))
        .when((text("payment_date") != "") & (~text("payment_date").rlike(r"^\d{4}-\d\d-\d\d$") | F.try_to_date(text("payment_date"), "yyyy-MM-dd").isNull()), bad("payment_date")).when(~code("payment_method"), bad("payment_method"))
        .when(~share("itbis_proportional"), bad("itbis_proportional")).when(~share("itbis_to_cost"), bad("itbis_to_cost")).when((text("isr_retention_type") != "") & ~code("isr_retention_type"), bad("isr_retention_type"))
    )
    kept = [c for c in rows.columns if c not in ("reported", *CODES, "split", "payment_date", "itbis_proportional", "itbis_to_cost")]
    return rows.select(
        *kept, yes.alias("reported"), *[F.nullif(text(c), F.lit("")).try_cast("int").alias(c) for c in CODES], F.nullif(text("split"), F.lit("")).alias("split"),
        F.try_to_date(text("payment_date"), "yyyy-MM-dd").alias("payment_date"), *[F.nullif(text(c), F.lit("")).alias(c) for c in ("itbis_proportional", "itbis_to_cost")], error.alias("error"),
    )


def filed_by_type(documents: DataFrame, sheet: DataFrame) -> DataFrame:
    """Documents (doc, document_id) with the filing row of their type of e-NCF (`ecf_type`), told by an
    E and twelve digits; one whose number names no type has none."""
    return documents.withColumn("ecf_type", F.nullif(F.regexp_extract("document_id", r"^(E\d{2})\d{10}$", 1), F.lit(""))).join(sheet, "ecf_type", "left")


def rate(kind: Column, day: Column) -> Column:
    """The retention rate in force for a type on a day; null where none is."""
    out = F.lit(None).cast("decimal(5,4)")
    for code, rates in RATES.items():
        for since, value in rates:
            out = F.when((kind == code) & (day >= F.lit(since).cast("date")), F.lit(value).cast("decimal(5,4)")).otherwise(out)
    return out


def _money(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(20,2)").cast("string")


def outcomes(documents: DataFrame, reporter: str) -> DataFrame:
    """`doc, period, line, reasons, left_out, rate_source` of each reported document.

    Failures of the reading itself come first, in order; then a small consumo is left out; then the
    retention, which needs a rate. A document not read, without a date or with one that does not
    read, is of no month. Dates are read day first. Amounts are kept to eight decimals.
    """
    first = lambda f: F.get(F.filter(F.get(F.array(F.col("values")[f]), F.lit(0)), lambda x: F.trim(x) != ""), F.lit(0))
    keep = ["doc", "purchase_type", "split", "payment_date", "payment_method", "itbis_proportional", "itbis_to_cost", "isr_retention_type"]
    read = documents.where("reported").select(
        *keep, F.col("values").isNotNull().alias("was_read"), identifiers.compact(F.upper(first("document_id"))).alias("ncf"), identifiers.compact(first("vendor_tax_id")).alias("vendor"), identifiers.compact(first("customer_tax_id")).alias("buyer"),
        identifiers.compact(F.upper(first("document_id_modified"))).alias("modified"), first("date_issue").alias("issued"), F.to_date(normalize.date(first("date_issue"), day_first=True)).alias("day"),
        *[F.when(first(a).isNull(), F.lit(0).cast(MONEY)).otherwise(normalize.number(first(a)).try_cast(MONEY)).alias(a) for a in AMOUNTS], first("amount_retention_isr").isNotNull().alias("isr_printed"),
    )
    kind = F.substring("ncf", 1, 3)
    good_ncf = F.coalesce(identifiers.receipt(F.col("ncf")), F.lit(False))
    read = read.withColumns({"good": good_ncf, "id": F.when(good_ncf & kind.isin(*SMALL_EXPENSES), F.lit(identifiers_compact(reporter))).otherwise(F.col("vendor"))})
    tipo = F.when(identifiers.taxpayer(F.col("id")), "1").when(identifiers.citizen(F.col("id")), "2")
    note = F.col("good") & kind.isin(*NOTES)
    net, itbis = F.col("amount_total_net"), F.col("amount_total_tax")
    services = F.when(F.col("split") == "services", net).when(F.col("split") == "goods", F.lit(0).cast(MONEY)).otherwise(F.col("split").try_cast(MONEY))
    part = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast(MONEY)).when(F.col(c) == "all", itbis).otherwise(F.col(c).try_cast(MONEY))
    usable = lambda a: F.col(a).isNotNull() & (F.col(a) >= 0)
    bad = [
        F.when(F.col("ncf").isNull(), "no NCF").when(~F.col("good"), "NCF invalid"), F.when(F.col("id").isNull(), "no RNC").when(tipo.isNull(), "RNC or cedula invalid"),
        F.when(F.col("buyer").isNotNull() & (F.col("buyer") != identifiers_compact(reporter)), "buyer is not the reporter"), F.when(note & F.col("modified").isNotNull() & ~F.coalesce(identifiers.receipt(F.col("modified")), F.lit(False)), "modified NCF invalid"),
        F.when(F.col("issued").isNull(), "no date").when(F.col("day").isNull(), "date unreadable"),
        *[F.when(F.col(a).isNull(), f"{a} unreadable").when(F.col(a) < 0, f"{a} negative") for a in AMOUNTS],
        F.when(~F.coalesce("split", F.lit("")).isin("services", "goods") & usable("amount_total_net") & (services > net), "services split above the net amount"),
        F.when(usable("amount_total_tax") & usable("amount_retention_itbis") & (F.col("amount_retention_itbis") > itbis), "ITBIS retention above the ITBIS"),
        *[F.when(usable("amount_total_tax") & F.col(c).isNotNull() & (part(c) > itbis), f"{n} above the ITBIS") for c, n in (("itbis_proportional", "ITBIS to proportionality"), ("itbis_to_cost", "ITBIS to cost"))],
    ]
    total = sum((F.col(a) for a in ("amount_total_tax", "amount_tax_selective", "amount_tax_other", "amount_tip")), net)
    staged = read.withColumns({"tipo": tipo, "services": services, "to_cost": part("itbis_to_cost"), "proportional": part("itbis_proportional"), "first_reasons": F.when(F.col("was_read"), F.array_compact(F.array(*bad))).otherwise(F.array(F.lit("no reading")))})
    clean = F.size("first_reasons") == 0
    left_out = clean & kind.isin(*CONSUMO) & (total <= F.lit(CONSUMO_MOST).cast(MONEY))
    computes = F.col("isr_retention_type").isNotNull() & usable("amount_total_net") & ~F.col("isr_printed") & (F.col("services") != 0)
    picked = F.coalesce("payment_date", "day")
    staged = staged.withColumns({"left": left_out, "computes": computes, "rate": rate(F.col("isr_retention_type"), picked), "picked": picked})
    no_rate = F.when(F.col("computes") & F.col("picked").isNotNull() & F.col("rate").isNull(), F.concat(F.lit("no ISR rate for retention type "), F.col("isr_retention_type").cast("string")))
    reasons = F.when(F.col("left"), F.array().cast("array<string>")).otherwise(F.array_compact(F.concat("first_reasons", F.array(no_rate))))
    isr = F.when(F.col("computes"), (F.col("services") * F.col("rate")).cast(MONEY)).otherwise(F.col("amount_retention_isr"))
    zero = F.lit("0.00")
    fields = [
        F.col("id"), F.col("tipo"), F.lpad(F.col("purchase_type").cast("string"), 2, "0"), F.col("ncf"), F.coalesce(F.when(note, F.col("modified")), F.lit("")), F.date_format("day", "yyyyMMdd"), F.coalesce(F.date_format("payment_date", "yyyyMMdd"), F.lit("")),
        _money(F.col("services")), _money(net - F.col("services")), _money(net), _money(itbis), _money(F.col("amount_retention_itbis")), _money(F.col("proportional")), _money(F.col("to_cost")), _money(itbis - F.col("to_cost")), zero,
        F.coalesce(F.lpad(F.col("isr_retention_type").cast("string"), 2, "0"), F.lit("")), _money(isr), zero, _money(F.col("amount_tax_selective")), _money(F.col("amount_tax_other")), _money(F.col("amount_tip")), F.col("payment_method").cast("string"),
    ]
    out = staged.withColumn("reasons", reasons)
    source = F.when(F.col("computes") & F.col("rate").isNotNull() & (F.size("reasons") == 0) & ~F.col("left"), F.when(F.col("payment_date").isNotNull(), "payment date").otherwise("comprobante date"))
    return out.select(
        "doc", F.coalesce(F.date_format("day", "yyyyMM"), F.lit(NO_MONTH)).alias("period"), F.when((F.size("reasons") == 0) & ~F.col("left"), F.concat_ws("|", *fields)).alias("line"), "reasons",
        F.when(F.col("left"), f"consumo of RD${float(CONSUMO_MOST):,.2f} or less").alias("left_out"), source.alias("rate_source"),
    )


def identifiers_compact(text: str) -> str:
    return "".join(text.split()).replace("-", "")


def months(found: DataFrame) -> DataFrame:
    """`period, lines, failures, failed` of each month; any failure fails it. Documents left out are in none."""
    kept = found.where("left_out is null")
    return kept.groupBy("period").agg(F.count("line").alias("lines"), F.count_if(F.size("reasons") > 0).alias("failures"), F.bool_or(F.size("reasons") > 0).alias("failed"))


def sides(readings: DataFrame, labels: DataFrame, filing: DataFrame, reporter: str) -> DataFrame:
    """The outcomes of what was read and, as control, of the labels, told by `side`. `readings` and
    `labels` have doc and values; every document of `filing` is on both sides, read or not."""
    one = lambda df, side: outcomes(filing.join(df.select("doc", "values"), "doc", "left"), reporter).withColumn("side", F.lit(side))
    return one(readings, "reading").unionByName(one(labels, "control"))


def reasons_by_month(found: DataFrame) -> DataFrame:
    """`period, reason, n` of the failures."""
    return found.select("period", F.explode("reasons").alias("reason")).groupBy("period", "reason").agg(F.count("*").alias("n"))


def prevalidated(outputs: DataFrame) -> DataFrame:
    """A pre-validator's printed blocks (`period`, `text`) read: `errors`, the count it states, `listed`,
    the numbered lines it lists, and `sound`: finished, with a count that reads and agrees."""
    status, count = F.regexp_extract("text", r"(?m)^status:\s*(.*?)\s*$", 1), F.regexp_extract("text", r"(?m)^errors:[ \t]*(\S*)", 1)
    box = F.regexp_extract("text", r"(?s)^error box:\s*(.*)$|\nerror box:\s*\n?(.*)$", 2)
    listed = F.size(F.regexp_extract_all(box, F.lit(r"(?m)^\s*\d+[.)-]\s*(.+)$"), 1))
    errors = F.when(count == "", F.lit(0)).otherwise(count.try_cast("int"))
    return outputs.select("period", errors.alias("errors"), listed.alias("listed"), (status.rlike("(?i)^completed") & errors.isNotNull() & (errors == listed)).alias("sound"))
