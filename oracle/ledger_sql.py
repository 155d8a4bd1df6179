"""DuckDB statements giving the expected results.

They are written from the definitions of the reports, not from the Spark plans: openings, lines
and totals are separate statements, match sets are EXISTS tests, running balances are plain
windows over whole accounts.
"""

from __future__ import annotations

M = "DECIMAL(18,2)"

TABLES = f"""
sale AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_custkey * 2 AS pid,
         n_nationkey AS nat, n_regionkey AS reg, o_orderstatus AS st,
         CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_totalprice END AS {M}) AS amt
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
bill AS (
  SELECT k, d, l_suppkey * 2 + 1 AS pid, n_nationkey AS nat, n_regionkey AS reg, st, amt FROM (
    SELECT l_orderkey * 65536 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS k, l_suppkey, CAST(min(l_shipdate) AS DATE) AS d,
           max(l_linestatus) AS st, CAST(sum(CAST(l_extendedprice AS {M})) AS {M}) AS amt
    FROM lineitem GROUP BY l_orderkey, l_suppkey)
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
legs AS (
  SELECT k*4 AS move_id, 0 AS leg, d, true AS bill_due, 41100+nat AS acc, 1 AS jrn, amt AS signed,
         k*2 AS match, NULL AS ana, NULL AS disp, CASE st WHEN 'P' THEN 'draft' ELSE 'posted' END AS state,
         'SAL/' AS prefix, k, pid, nat, st, CAST(NULL AS DATE) AS paid FROM sale
  UNION ALL SELECT k*4, 1, d, false, 70700+reg, 1, -amt, NULL,
         CASE WHEN nat%4<>0 THEN 100+nat END, NULL, CASE st WHEN 'P' THEN 'draft' ELSE 'posted' END,
         'SAL/', k, pid, nat, st, NULL FROM sale
  UNION ALL SELECT k*4, 2, d, false, 70700+reg, 1, CAST(0 AS {M}), NULL, NULL, 'line_note',
         CASE st WHEN 'P' THEN 'draft' ELSE 'posted' END, 'SAL/', k, pid, nat, st, NULL
         FROM sale WHERE k%50=0
  UNION ALL SELECT k*4+1, 0, CAST(d+15+CAST(k%90 AS INT) AS DATE), false, 5120, 3, amt, NULL, NULL, NULL,
         'posted', 'RCV/', k, pid, nat, st, NULL FROM sale WHERE st='F'
  UNION ALL SELECT k*4+1, 1, CAST(d+15+CAST(k%90 AS INT) AS DATE), false, 41100+nat, 3, -amt, k*2, NULL, NULL,
         'posted', 'RCV/', k, pid, nat, st, CAST(d+15+CAST(k%90 AS INT) AS DATE) FROM sale WHERE st='F'
  UNION ALL SELECT k*4+2, 0, d, true, 40100+nat, 2, -amt, k*2+1, NULL, NULL, 'posted', 'PUR/',
         k, pid, nat, st, NULL FROM bill
  UNION ALL SELECT k*4+2, 1, d, false, 60700+reg, 2, amt, NULL,
         CASE WHEN nat%4<>0 THEN 100+nat END, NULL, 'posted', 'PUR/', k, pid, nat, st, NULL FROM bill
  UNION ALL SELECT k*4+3, 0, CAST(d+15+CAST(k%90 AS INT) AS DATE), false, 5120, 3, -amt, NULL, NULL, NULL,
         'posted', 'PAY/', k, pid, nat, st, NULL FROM bill WHERE st='F'
  UNION ALL SELECT k*4+3, 1, CAST(d+15+CAST(k%90 AS INT) AS DATE), false, 40100+nat, 3, amt, k*2+1, NULL, NULL,
         'posted', 'PAY/', k, pid, nat, st, CAST(d+15+CAST(k%90 AS INT) AS DATE) FROM bill WHERE st='F'),
item AS MATERIALIZED (
  SELECT move_id*4+leg AS id, move_id, CAST(acc AS BIGINT) AS account_id,
         CAST(jrn AS BIGINT) AS journal_id, pid AS partner_id, CAST(ana AS BIGINT) AS analytic_account_id,
         CASE WHEN st='F' THEN match END AS full_reconcile_id, d AS date,
         CASE WHEN bill_due AND k%11<>0 THEN CAST(d+30*(1+CAST(k%3 AS INT)) AS DATE)
              ELSE paid END AS date_maturity,
         CAST(CASE WHEN jrn=1 AND leg=0 OR jrn=2 AND leg=1 OR jrn=3 AND signed>0 THEN signed ELSE 0 END AS {M}) AS debit,
         CAST(CASE WHEN jrn=1 AND leg=1 OR jrn=2 AND leg=0 OR jrn=3 AND signed<0 THEN -signed ELSE 0 END AS {M}) AS credit,
         CAST(signed AS {M}) AS balance,
         CASE WHEN nat%5=1 THEN CAST(signed*2 AS {M}) END AS amount_currency,
         CAST(CASE WHEN nat%5=1 THEN 2 END AS BIGINT) AS currency_id, disp AS display_type,
         CASE WHEN k%7<>0 THEN 'Document ' || k END AS name, CASE WHEN k%3=0 THEN 'R' || k END AS ref,
         state, prefix || k AS move_name
  FROM legs),
account AS (
  SELECT CAST(id AS BIGINT) AS id, CAST(id AS VARCHAR) AS code, name, ttp, iib, unaffected,
         compacted, deprecated, reconcile, grp FROM (
    SELECT 1200 AS id, 'Unaffected earnings' AS name, 'no' AS ttp, true AS iib, true AS unaffected,
           false AS compacted, false AS deprecated, false AS reconcile, 12 AS grp
    UNION ALL SELECT 5120, 'Bank', 'no', true, false, true, false, false, 5
    UNION ALL SELECT 41100+n_nationkey, 'Customers ' || n_name, 'customer', true, false,
           n_nationkey%5=0, n_nationkey=24, true, 41 FROM nation
    UNION ALL SELECT 40100+n_nationkey, 'Suppliers ' || n_name, 'supplier', true, false, false,
           false, true, 40 FROM nation
    UNION ALL SELECT 70700+r_regionkey, 'Income ' || r_name, 'no', false, false,
           r_regionkey%2=0, false, false, 70 FROM region
    UNION ALL SELECT 60700+r_regionkey, 'Expenses ' || r_name, 'no', NULL, false, false, false,
           false, 60 FROM region)),
acc_group(id, parent) AS (VALUES (1,NULL),(2,NULL),(4,1),(5,1),(12,1),(40,4),(41,4),(60,2),(70,2)),
journal(id, code, name) AS (VALUES (1,'SAL','Sales'),(2,'PUR','Purchases'),(3,'BNK','Bank')),
partner AS (
  SELECT c_custkey*2 AS id, CASE WHEN c_custkey%3<>0 THEN 'C' || c_custkey END AS ref,
         c_name AS name, c_custkey%4=0 AS is_company,
         CASE WHEN c_custkey%5=1 THEN (c_custkey-1)*2 END AS parent_id FROM customer
  UNION ALL SELECT s_suppkey*2+1, 'S' || s_suppkey, s_name, true, NULL FROM supplier),
analytic AS (
  SELECT CAST(100+n_nationkey AS BIGINT) AS id,
         CASE WHEN n_nationkey%2=0 THEN 'N' || n_nationkey END AS code, n_name AS name FROM nation)
"""

KEY = {"account": "account_id", "partner": "partner_id", "journal": "journal_id",
       "analytic": "analytic_account_id"}
AGES = ["current", "age_30_days", "age_60_days", "age_90_days", "age_120_days", "older"]

# How each kind of column is compared: amounts as doubles, dates and flags as text.
_MONEY = ["debit", "credit", "balance", "cumul_balance", *AGES, "amount_currency", "total"]
_TEXT = ["date", "date_maturity", "reconciled"]


def shown(columns: list[str], source: str, tenth: bool = False) -> str:
    def column(name: str) -> str:
        if name in _MONEY and tenth:
            return f'CAST(CAST("{name}" AS DECIMAL(28,2)) * 0.1 AS DOUBLE) AS "{name}"'
        if name in _MONEY:
            return f'CAST("{name}" AS DOUBLE) AS "{name}"'
        if name in _TEXT:
            return f'CAST("{name}" AS VARCHAR) AS "{name}"'
        return f'"{name}"'
    return f"SELECT {', '.join(column(c) for c in columns)} FROM {source}"


LINE = ["line_type", "view_type", "report_object_id", "account_id", "partner_id", "journal_id",
        "analytic_account_id", "move_id", "move_line_id", "date", "date_maturity", "debit",
        "credit", "balance", "cumul_balance", *AGES, "full_reconcile_id", "reconciled",
        "amount_currency", "currency_id", "item_name", "item_ref", "move_name"]
TOTAL = ["line_type", "report_object_id", "account_id", "partner_id", "journal_id",
         "analytic_account_id", "date", "debit", "credit", "balance", "cumul_balance", *AGES]


def _ids(column: str, ids) -> str:
    return f" AND {column} IN ({', '.join(map(str, ids))})" if ids else ""


def report(o, p: str = "") -> str:
    """CTEs of one (normalised) report; `p` prefixes their names. `{p}lines` holds all rows."""
    a, b = f"DATE '{o.date_from}'", f"DATE '{o.date_to}'"
    key = KEY[o.report_type]
    states = ", ".join(f"'{s}'" for s in o.states)
    third = {"customer": "ttp = 'customer'", "supplier": "ttp = 'supplier'",
             "customer_supplier": "ttp IN ('customer', 'supplier')"}[o.result_selection]
    acc = "NOT deprecated" + _ids("id", o.account_select_ids)
    if o.report_type == "partner":
        acc += f" AND {third}"
    tree = ""
    if o.account_group_ids:
        roots = ", ".join(map(str, o.account_group_ids))
        acc += f" AND grp IN (SELECT id FROM {p}tree)"
        tree = f"""{p}tree AS (
  SELECT DISTINCT g.id FROM acc_group g LEFT JOIN acc_group u ON u.id = g.parent
  LEFT JOIN acc_group v ON v.id = u.parent
  WHERE g.id IN ({roots}) OR u.id IN ({roots}) OR v.id IN ({roots})),
"""
    lists = _ids("journal_id", o.journal_ids)
    if o.report_type == "partner":
        lists += _ids("partner_id", o.partner_ids)
    if o.report_type == "analytic":
        lists += _ids("analytic_account_id", o.analytic_account_ids)

    compact = "coalesce(compacted, false)" if o.compact_account else "false"
    from_on = f"(i.full_reconcile_id IS NOT NULL AND EXISTS (FROM {p}from_on f WHERE f.id = i.full_reconcile_id))"
    past_to = f"(i.full_reconcile_id IS NOT NULL AND EXISTS (FROM {p}past_to f WHERE f.id = i.full_reconcile_id))"
    done = f"(i.full_reconcile_id IS NOT NULL AND NOT {past_to})"
    item_open = f"(ttp IN ('customer', 'supplier') AND (i.full_reconcile_id IS NULL OR {from_on}))"
    if o.report_type == "journal":
        when = f"i.date >= {a}"
    elif o.ledger_type == "open":
        when = f"i.date < {a} AND {item_open}"
    else:
        when = f"(i.date >= {a} OR {item_open})"
    hide = "" if o.reconciled else f" AND NOT {done}"

    def side(sums: str, positive: bool) -> str:
        if o.init_balance_history:
            return f"coalesce(sum({'debit' if positive else 'credit'}), 0)"
        return f"greatest(coalesce({'' if positive else '-'}sum(balance), 0), 0)"

    opening = "SELECT NULL AS k, NULL AS acc, NULL AS par, 0 AS debit, 0 AS credit, 0 AS balance WHERE false"
    if o.has_opening:
        par = "partner_id" if o.report_type == "partner" else "NULL"
        keep = "abs(sum(balance)) > 0.005"
        if o.init_balance_history:
            keep += " OR abs(sum(debit)) > 0.005"
        opening = f"""SELECT min({key}) AS k, min(account_id) AS acc, {"min(partner_id)" if par != "NULL" else "NULL"} AS par,
    {side("", True)} AS debit, {side("", False)} AS credit, sum(balance) AS balance
  FROM {p}scope i WHERE date < {a} AND iib IS TRUE
    AND ({compact} OR ttp = 'no' OR (i.full_reconcile_id IS NOT NULL AND NOT {from_on}))
  GROUP BY {"account_id" if par == "NULL" else "partner_id, account_id"} HAVING {keep}"""
    if o.report_type == "account":
        opening += f"""
  UNION ALL SELECT u.id, u.id, NULL, r.debit, r.credit, r.balance
  FROM (SELECT {side("", True)} AS debit, {side("", False)} AS credit, coalesce(sum(balance), 0) AS balance
        FROM item JOIN account ac ON ac.id = account_id
        WHERE display_type IS NULL AND state IN ({states}) AND date < {a} AND iib IS NOT TRUE) r,
       (SELECT id FROM {p}acc WHERE unaffected) u"""

    run_key = o.running_column
    before = (f"coalesce((SELECT sum(q.balance) FROM {p}opening q WHERE q.k = l.{key}), 0) + "
              if run_key == key and o.has_opening else "")
    edges = [b] + [f"{b} - {n}" for n in (30, 60, 90, 120)]
    ages = [f"CASE WHEN date_maturity > {edges[0]} THEN balance END AS current"]
    ages += [f"CASE WHEN date_maturity <= {n} AND date_maturity > {m} THEN balance END AS {c}"
             for n, m, c in zip(edges, edges[1:], AGES[1:])]
    ages.append(f"CASE WHEN date_maturity <= {edges[-1]} THEN balance END AS older")
    none = ", ".join(f"NULL AS {c}" for c in AGES)

    compact_rows = ""
    if o.compact_account:
        compact_rows = f"""
  UNION ALL BY NAME SELECT '3_compact' AS line_type, 'normal' AS view_type, account_id AS report_object_id,
    account_id, {a} AS date, sum(debit) AS debit, sum(credit) AS credit, sum(balance) AS balance,
    coalesce((SELECT sum(q.balance) FROM {p}opening q WHERE q.k = account_id), 0) + sum(balance) AS cumul_balance
  FROM {p}scope WHERE compacted AND date BETWEEN {a} AND {b} GROUP BY account_id"""

    sums = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in ["debit", "credit", "balance", *AGES])
    return f"""{tree}{p}acc AS (SELECT * FROM account WHERE {acc}),
{p}from_on AS (SELECT DISTINCT full_reconcile_id AS id FROM item WHERE full_reconcile_id IS NOT NULL AND date >= {a}),
{p}past_to AS (SELECT DISTINCT full_reconcile_id AS id FROM item WHERE full_reconcile_id IS NOT NULL AND date > {b}),
{p}scope AS (
  SELECT i.*, ttp, iib, compacted FROM item i JOIN {p}acc c ON c.id = i.account_id
  WHERE display_type IS NULL AND state IN ({states}) AND {key} IS NOT NULL{lists}),
{p}opening AS ({opening}),
{p}body AS (
  SELECT '0_init' AS line_type, 'init' AS view_type, k AS report_object_id, acc AS account_id,
    CAST(par AS BIGINT) AS partner_id, CAST(NULL AS BIGINT) AS journal_id, CAST(NULL AS BIGINT) AS analytic_account_id,
    CAST(NULL AS BIGINT) AS move_id, CAST(NULL AS BIGINT) AS move_line_id, {a} AS date, CAST(NULL AS DATE) AS date_maturity,
    debit, credit, balance, balance AS cumul_balance, {none}, CAST(NULL AS BIGINT) AS full_reconcile_id,
    false AS reconciled, NULL AS amount_currency, CAST(NULL AS BIGINT) AS currency_id,
    CAST(NULL AS VARCHAR) AS item_name, CAST(NULL AS VARCHAR) AS item_ref, CAST(NULL AS VARCHAR) AS move_name
  FROM {p}opening
  UNION ALL BY NAME
  SELECT CASE WHEN date >= {a} THEN '2_line' ELSE '1_init_line' END AS line_type,
    CASE WHEN date >= {a} THEN 'normal' ELSE 'init' END AS view_type, {key} AS report_object_id,
    account_id, partner_id, journal_id, analytic_account_id, move_id, id AS move_line_id, date, date_maturity,
    debit, credit, balance,
    {before}sum(balance) OVER (PARTITION BY {run_key} ORDER BY date, id) AS cumul_balance,
    {", ".join(ages)}, full_reconcile_id, done AS reconciled, amount_currency, currency_id,
    name AS item_name, ref AS item_ref, move_name
  FROM (SELECT i.*, {done} AS done FROM {p}scope i
        WHERE date <= {b} AND {when} AND abs(balance) > 0.005 AND NOT {compact}{hide}) l{compact_rows}),
{p}totals AS (
  SELECT '4_total' AS line_type, 'total' AS view_type, report_object_id, {a} AS date, {sums},
    coalesce(sum(balance), 0) AS cumul_balance, report_object_id AS {key}
  FROM {p}body GROUP BY report_object_id),
{p}grand AS (
  SELECT '5_super_total' AS line_type, 'total' AS view_type, {a} AS date, {sums},
    coalesce(sum(balance), 0) AS cumul_balance FROM {p}totals),
{p}lines AS (SELECT * FROM {p}body UNION ALL BY NAME SELECT * FROM {p}totals
  UNION ALL BY NAME SELECT * FROM {p}grand),
{p}all_totals AS (SELECT * FROM {p}lines WHERE line_type >= '4')"""


def statement(final: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([TABLES.strip(), *[c for c in ctes if c]]) + "\n" + final


def lines_sql(o, tenth: bool = False) -> str:
    """All lines of a (normalised) report."""
    columns, source = (TOTAL, "all_totals") if o.summary else (LINE, "lines")
    return statement(shown(columns, source, tenth), report(o))


NAMES = {
    "account": "SELECT id, code || ' ' || name AS object_name, code, name, code || ' ' || name AS heading FROM account",
    "journal": "SELECT id, code || ' ' || name AS object_name, code, name, name AS heading FROM journal",
    "partner": "SELECT id, CASE WHEN ref IS NULL THEN name ELSE ref || ' ' || name END AS object_name, ref AS code, name, name || ' (display)' AS heading FROM partner",
    "analytic": "SELECT id, CASE WHEN code IS NULL THEN name ELSE code || ' ' || name END AS object_name, code, name, CASE WHEN code IS NULL THEN name ELSE '[' || code || '] ' || name END AS heading FROM analytic",
}


def labelled(o) -> str:
    """CTE `labelled`: report lines with their labels."""
    return f"""object_label AS ({NAMES[o.report_type]}),
labelled AS (
  SELECT l.*, n.object_name, n.code, n.name, n.heading, j.code AS j_code, c.code AS a_code, c.name AS a_name,
    y.code AS an_code, y.name AS an_name, r.name || ' (display)' AS partner_name,
    CASE l.currency_id WHEN 2 THEN 'EUR' END AS currency,
    CASE WHEN l.full_reconcile_id IS NULL THEN '' WHEN l.reconciled THEN 'A' || l.full_reconcile_id ELSE '*' END AS matching_number
  FROM lines l LEFT JOIN object_label n ON n.id = l.report_object_id
  LEFT JOIN journal j ON j.id = l.journal_id LEFT JOIN account c ON c.id = l.account_id
  LEFT JOIN analytic y ON y.id = l.analytic_account_id LEFT JOIN partner r ON r.id = l.partner_id)"""
