"""The DuckDB statement of every registered query."""

from __future__ import annotations

from dataclasses import replace

from oracle.cases import CASES, TODAY, nation_report
from oracle.ledger_sql import (
    AGES, KEY, LINE, NAMES, TOTAL, labelled, lines_sql, report, shown, statement)
from oracle.settings import settled

OBJECTS = {"account": "general_ledger_detail", "partner": "partner_ledger_detail",
           "journal": "journal_ledger_detail", "analytic": "analytic_ledger_detail"}
JOINED = ("general_ledger_trial_balance", "general_ledger_detail", "partner_ledger_open_items",
          "partner_ledger_open_trial_balance", "journal_ledger_detail", "aged_balance_summary")
STORED = ("journal_ledger_detail", "aged_balance_detail")
SIDE_BY_SIDE = ("general_ledger_selected", "partner_ledger_selected", "journal_ledger_trial_balance")

_KEYS = ["report_object_id", "object_name", "line_type", "move_line_id"]
PIVOT = [*_KEYS, "date_label", "journal", "account", "account_name", "analytic", "entry", "ref",
         "name", "partner", "due_date", "debit", "credit", "balance", "amount_currency",
         "currency", "match"]
AGED_PIVOT = [*_KEYS, "date_label", "journal", "account", "account_name", "entry", "ref",
              "partner", "due_date", *AGES, "balance", "match"]
SECTION = ["section_part", "heading", *PIVOT]
AGED_SECTION = ["section_part", "heading", *AGED_PIVOT]
STATEMENT = ["block", *_KEYS, "label", "journal", "account", "analytic", "entry", "ref",
             "partner", "due_date", "debit", "credit", "balance", "amount_currency", "match"]
AGED_STATEMENT = ["block", *_KEYS, "label", "journal", "account", "entry", "due_date", *AGES,
                  "balance", "match"]
US = "'%m/%d/%Y'"


def _case(name: str):
    return settled(CASES[name], TODAY)


def _objects(kind: str) -> str:
    o, key = _case(OBJECTS[kind]), KEY[kind]
    ids = "".join(f" AND {c} IN ({', '.join(map(str, v))})" for c, v in (
        ("analytic_account_id", o.analytic_account_ids),) if v)
    extra = " UNION SELECT id FROM account WHERE unaffected" if kind == "account" else ""
    typed = ", ".join((f"k AS {c}" if c == key else f"CAST(NULL AS BIGINT) AS {c}")
                      for c in KEY.values())
    accounts = "NOT deprecated" + (" AND ttp IN ('customer', 'supplier')" if kind == "partner" else "")
    return statement(f"""
SELECT k AS object_id, object_name AS name, {typed}
FROM (SELECT {key} AS k FROM item WHERE display_type IS NULL{ids}
        AND account_id IN (SELECT id FROM account WHERE {accounts}){extra} GROUP BY ALL) keys
LEFT JOIN ({NAMES[kind]}) n ON n.id = k""")


def _opening(name: str) -> str:
    o = _case(name)
    group = "'-' || acc" if o.report_type == "account" else "par || '-' || acc"
    # The result of prior years is a separate query: leave it out by its account.
    return statement(f"""
SELECT k AS report_object_id, acc AS account_id, {group} AS group_key, '{o.date_from}' AS date,
  CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit,
  CAST(balance AS DOUBLE) AS balance, CAST(balance AS DOUBLE) AS cumul_balance
FROM opening WHERE acc <> 1200""", report(o))


def _unaffected(name: str) -> str:
    o = _case(name)
    return statement(f"""
SELECT k AS report_object_id, acc AS account_id, '{o.date_from}' AS date,
  CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit,
  CAST(balance AS DOUBLE) AS balance
FROM opening WHERE acc = 1200""", report(o))


def _search(condition: str) -> str:
    return statement(shown(
        ["line_type", "account_id", "move_id", "move_line_id", "date", "balance"],
        f"""(SELECT l.*, i.state, c.ttp, c.reconcile FROM body l
  JOIN item i ON i.id = l.move_line_id JOIN account c ON c.id = l.account_id) WHERE {condition}"""),
        report(_case("general_ledger_all_moves")))


def _date(column: str) -> str:
    return f"strftime({column}, {US})"


_PIVOT_SQL = f"""pivot_rows AS (
  SELECT report_object_id, object_name, line_type, move_line_id,
    CASE view_type WHEN 'init' THEN 'INIT' ELSE {_date('date')} END AS date_label,
    j_code AS journal, a_code AS account, a_name AS account_name,
    coalesce(an_code || ' - ', '') || an_name AS analytic, move_name AS entry, item_ref AS ref,
    item_name AS name, partner_name AS partner, {_date('date_maturity')} AS due_date,
    debit, credit, cumul_balance AS balance,
    CASE WHEN amount_currency <> 0 THEN amount_currency END AS amount_currency,
    CASE WHEN amount_currency <> 0 THEN currency END AS currency, matching_number AS "match", heading
  FROM labelled WHERE line_type < '4')"""

_AGED_PIVOT_SQL = f"""pivot_rows AS (
  SELECT report_object_id, object_name, line_type, move_line_id, {_date('date')} AS date_label,
    j_code AS journal, a_code AS account, a_name AS account_name, move_name AS entry,
    item_name AS ref, partner_name AS partner, {_date('date_maturity')} AS due_date,
    {", ".join(f"coalesce({c}, 0) AS {c}" for c in AGES)}, balance, matching_number AS "match",
    name AS heading
  FROM labelled WHERE line_type IN ('1_init_line', '2_line'))"""


def _pivot(name: str, tenth: bool = False) -> str:
    o = _case(name)
    aged = o.ledger_type == "aged"
    return statement(shown(AGED_PIVOT if aged else PIVOT, "pivot_rows", tenth),
                     report(o), labelled(o), _AGED_PIVOT_SQL if aged else _PIVOT_SQL)


def _sections(name: str, tenth: bool = False) -> str:
    o = _case(name)
    aged = o.ledger_type == "aged"
    sums = ", ".join(f"sum({c}) AS {c}" for c in ([*AGES, "balance"] if aged else ["debit", "credit"]))
    section = f"""section AS (
  SELECT '1_line' AS section_part, * EXCLUDE (heading) FROM pivot_rows
  UNION ALL BY NAME SELECT DISTINCT '0_heading' AS section_part, report_object_id, object_name, heading FROM pivot_rows
  UNION ALL BY NAME SELECT '2_totals' AS section_part, report_object_id, object_name, {sums}
    FROM pivot_rows GROUP BY report_object_id, object_name)"""
    return statement(shown(AGED_SECTION if aged else SECTION, "section", tenth),
                     report(o), labelled(o), _AGED_PIVOT_SQL if aged else _PIVOT_SQL, section)


def _statement(name: str) -> str:
    o = _case(name)
    if o.ledger_type == "aged":
        def amount(c: str) -> str:
            return f"CASE WHEN line_type = '5_super_total' OR {c} <> 0 THEN {c} END AS {c}"
        rows = f"""printed AS (
  SELECT CASE line_type WHEN '5_super_total' THEN 0 ELSE 1 END AS block, report_object_id, object_name,
    line_type, move_line_id, CASE view_type WHEN 'total' THEN 'Total' ELSE {_date('date')} END AS label,
    j_code AS journal, a_code AS account, move_name AS entry, {_date('date_maturity')} AS due_date,
    {", ".join(amount(c) for c in AGES)}, balance,
    CASE WHEN view_type <> 'total' THEN matching_number END AS "match"
  FROM labelled)"""
        return statement(shown(AGED_STATEMENT, "printed"), report(o), labelled(o), rows)
    wanted = "line_type >= '4'" if o.summary else "true"
    total_label = "object_name" if o.summary else "'Total'"
    rows = f"""printed AS (
  SELECT CASE line_type WHEN '5_super_total' THEN 0 ELSE 1 END AS block, report_object_id, object_name,
    line_type, move_line_id,
    CASE line_type WHEN '0_init' THEN 'INIT' WHEN '3_compact' THEN 'Compact' WHEN '4_total' THEN {total_label}
      WHEN '5_super_total' THEN 'Total' ELSE {_date('date')} END AS label,
    CASE WHEN view_type <> 'total' THEN j_code END AS journal,
    CASE WHEN view_type <> 'total' THEN a_code END AS account,
    CASE WHEN view_type <> 'total' THEN coalesce(an_code || ' - ', '') || an_name END AS analytic,
    move_name AS entry, item_ref AS ref, CASE WHEN view_type <> 'total' THEN partner_name END AS partner,
    {_date('date_maturity')} AS due_date,
    CASE WHEN line_type = '5_super_total' OR debit <> 0 THEN debit END AS debit,
    CASE WHEN line_type = '5_super_total' OR credit <> 0 THEN credit END AS credit,
    cumul_balance AS balance,
    CASE WHEN view_type = 'normal' AND amount_currency <> 0 THEN amount_currency END AS amount_currency,
    CASE WHEN view_type <> 'total' THEN matching_number END AS "match"
  FROM labelled WHERE {wanted})"""
    return statement(shown(STATEMENT, "printed"), report(o), labelled(o), rows)


def _summary(name: str, tenth: bool = False) -> str:
    o = _case(name)
    amounts = ([*AGES, "balance AS total"] if o.ledger_type == "aged"
               else ["debit", "credit", "balance"])
    columns = [a.split(" AS ")[-1] for a in amounts]
    return statement(
        shown(["report_object_id", "object_name", "code", "name", *columns],
              f"(SELECT * EXCLUDE (balance), {'balance AS total' if 'total' in columns else 'balance'} FROM labelled) WHERE line_type = '4_total'", tenth),
        report(o), labelled(o))


def _grouped(key: str, name: str) -> str:
    sums = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in ["debit", "credit", "balance", *AGES])
    return statement(
        shown([key, "line_count", "debit", "credit", "balance", *AGES, "cumul_balance"],
              f"(SELECT {key}, count(*) AS line_count, {sums}, sum(debit) - sum(credit) AS cumul_balance FROM body GROUP BY {key})"),
        report(_case(name)))


def _footer(name: str, columns: list[str]) -> str:
    return statement(f"SELECT {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in columns)} FROM body",
                     report(_case(name)))


def _multi() -> str:
    ctes, rows = [], []
    for n in range(25):
        o = settled(nation_report(n), TODAY)
        ctes.append(report(o, f"r{n}_"))
        rows.append(f"SELECT CAST({o.report_id} AS BIGINT) AS report_id, * FROM r{n}_all_totals")
    ctes.append("every AS (" + "\nUNION ALL BY NAME ".join(rows) + ")")
    return statement(shown(["report_id", *TOTAL], "every"), *ctes)


def _multi_detail() -> str:
    ctes, rows = [], []
    for n in range(25):
        o = settled(replace(nation_report(n), summary=False), TODAY)
        ctes.append(report(o, f"r{n}_"))
        rows.append(f"SELECT CAST({o.report_id} AS BIGINT) AS report_id, * FROM r{n}_lines")
    ctes.append("every AS (" + "\nUNION ALL BY NAME ".join(rows) + ")")
    return statement(shown(["report_id", *LINE], "every"), *ctes)


def _side_by_side(names: tuple[str, ...]) -> str:
    ctes, rows = [], []
    for i, name in enumerate(names, 1):
        o = _case(name)
        ctes.append(report(o, f"r{i}_"))
        source = "all_totals" if o.summary else "lines"
        rows.append(f"SELECT CAST({i} AS BIGINT) AS report_id, * FROM r{i}_{source}")
    ctes.append("every AS (" + "\nUNION ALL BY NAME ".join(rows) + ")")
    return statement(shown(["report_id", *LINE], "every"), *ctes)


def _fiscal() -> dict[str, str]:
    return {
        "fiscal_periods": statement(f"""
SELECT strftime(make_date(y, 1, 1), {US}) || ' - ' || strftime(make_date(y, 12, 31), {US}) AS name,
  y || '-01-01' AS date_from, y || '-12-31' AS date_to, count(*) AS n, CAST(sum(debit) AS DOUBLE) AS debit
FROM (SELECT year(date) AS y, debit FROM item) WHERE y IN (1998, 1999, 2000) GROUP BY y"""),
        "fiscal_months": statement("""
SELECT CAST(m AS VARCHAR) AS first_day, CAST(last_day(m) AS VARCHAR) AS last_day,
  count(*) AS n, CAST(sum(debit) AS DOUBLE) AS debit
FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS m, debit FROM item)
WHERE year(m) BETWEEN 1997 AND 2000 GROUP BY m"""),
    }


_LEDGERS = "['general', 'partner', 'journal', 'open', 'aged', 'analytic']"


def _options() -> dict[str, str]:
    def saved(plain: bool) -> str:
        empty = "false" if plain else "c_custkey % 4 = 3"
        ledger = f"list_extract({_LEDGERS}, 1 + CAST(c_custkey % 6 AS INT))"
        return f"""SELECT c_custkey AS k, {empty} AS empty,
    CASE WHEN {empty} THEN 'general' ELSE {ledger} END AS ledger_type,
    CASE WHEN c_custkey % 11 <> 0 THEN make_date(1997, 1 + CAST(c_custkey % 12 AS INT), 1) END AS f,
    CASE WHEN c_custkey % 13 <> 0 THEN make_date(1998, 1 + CAST(c_custkey % 12 AS INT), 1) END AS t,
    c_name FROM customer"""
    # Unlike a saved true, a saved false leaves the default: history and matched items stay on.
    dates = f"""CAST(CASE WHEN ledger_type = 'aged' THEN DATE '1970-01-01' ELSE coalesce(f, DATE '1970-01-01') END AS VARCHAR) AS date_from,
  CAST(coalesce(t, CASE WHEN ledger_type = 'aged' THEN DATE '{TODAY}' ELSE DATE '2099-01-01' END) AS VARCHAR) AS date_to"""
    return {
        "report_options": f"""
SELECT k AS report_id, CASE WHEN empty THEN 'Standard Report' ELSE c_name END AS name, ledger_type,
  CASE WHEN ledger_type IN ('general', 'open') THEN 'account' WHEN ledger_type IN ('partner', 'aged') THEN 'partner'
    ELSE ledger_type END AS report_type,
  CAST(k % 2 = 0 AS VARCHAR) AS summary,
  CASE WHEN empty OR k % 2 = 0 THEN 'posted' ELSE 'all' END AS target_move,
  CAST(ledger_type <> 'aged' AS VARCHAR) AS reconciled,
  CASE WHEN empty OR k % 2 = 1 THEN 'supplier' ELSE 'customer' END AS result_selection,
  CAST(ledger_type = 'general' AND k % 5 = 0 AS VARCHAR) AS compact_account,
  'true' AS init_balance_history, {dates},
  CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS journals,
  CASE WHEN ledger_type IN ('partner', 'aged') AND k % 6 < 2 THEN 3 ELSE 0 END AS partners
FROM ({saved(False)})""",
        "company_reports": f"""
SELECT k AS report_id, CAST(1 AS BIGINT) AS company_id, ledger_type,
  CAST(CASE WHEN k % 3 = 0 OR ledger_type = 'aged' THEN f
    WHEN k % 5 = 0 THEN make_date(CAST(1997 + k % 4 AS INT), CAST(k % 12 + 1 AS INT), 1)
    ELSE make_date(CAST(1997 + k % 4 AS INT), 1, 1) END AS VARCHAR) AS date_from,
  CAST(CASE WHEN k % 3 = 0 OR ledger_type = 'aged' THEN t
    WHEN k % 5 = 0 THEN last_day(make_date(CAST(1997 + k % 4 AS INT), CAST(k % 12 + 1 AS INT), 1))
    ELSE make_date(CAST(1997 + k % 4 AS INT), 12, 31) END AS VARCHAR) AS date_to
FROM ({saved(True)}) WHERE k % 2 = 0""",
        "report_dim": f"""
SELECT k AS report_id,
  CASE ledger_type WHEN 'aged' THEN 'Aged Balance' ELSE upper(ledger_type[1]) || ledger_type[2:] || ' Ledger' END
    || CASE WHEN k % 2 = 0 THEN ' Balance' ELSE '' END AS report_name,
  'Main company' AS company, 'USD' AS currency, {dates},
  CASE WHEN k % 2 = 0 THEN 'All Posted Entries' ELSE 'All Entries' END AS target_moves,
  CASE WHEN ledger_type = 'aged' OR (ledger_type = 'partner' AND k % 3 <> 0)
    THEN 'Only UnReconciled Entries' ELSE 'With Reconciled Entries' END AS matching,
  '1998-12-31 12:00:00' AS print_time
FROM ({saved(True)})""",
    }


_NUMBERS = """numbers AS (
  SELECT DISTINCT message_id, number FROM (
    SELECT event_id // 10 AS message_id, regexp_replace(
      CASE event_id % 6 WHEN 0 THEN '+33 ' || u WHEN 1 THEN '(33)-' || u WHEN 2 THEN '0' || u || '^'
        WHEN 3 THEN u[1:6] WHEN 4 THEN u || u ELSE '+3.3/' || u END, '[^0-9^+]', '', 'g') AS number
    FROM (SELECT event_id, lpad(CAST(user_id AS VARCHAR), 9, '1') AS u FROM events))
  WHERE length(number) BETWEEN 7 AND 15)"""
_MESSAGES = """messages AS (
  SELECT DISTINCT event_id // 10 AS message_id,
    list_extract(['primary', 'backup', 'other'], 1 + CAST((event_id // 10) % 3 AS INT)) AS provider FROM events)"""


def _outbound() -> dict[str, str]:
    return {
        "outbound_recipients": f"WITH {_NUMBERS} SELECT message_id, number FROM numbers",
        "outbound_routes": f"""WITH {_MESSAGES}
SELECT message_id, provider, CASE provider WHEN 'other' THEN 'default' ELSE provider END AS route,
  CASE provider WHEN 'backup' THEN 'application_secret,sender' END AS missing_settings FROM messages""",
        "outbound_jobs": f"""WITH {_NUMBERS}, {_MESSAGES},
counts AS (SELECT message_id, count(*) AS n FROM numbers GROUP BY message_id)
SELECT message_id, provider, 'sms-1' AS sms_account, coalesce(n, 0) AS receiver_count,
  CAST(to_json({{charset: 'UTF-8', coding: '7bit', message: 'Message "no" ' || message_id,
    noStopClause: true, priority: 'high', senderForResponse: false, validityPeriod: 2880,
    sender: 'Books'}}) AS VARCHAR) AS job
FROM messages LEFT JOIN counts USING (message_id) WHERE provider = 'primary'""",
        "outbound_job_receivers": f"""WITH {_NUMBERS}, {_MESSAGES}
SELECT message_id, provider, number FROM numbers JOIN messages USING (message_id)
WHERE provider = 'primary'""",
        "outbound_replies": """
SELECT message_id, c AS total_credits_removed, CAST(coalesce(c > 0, false) AS VARCHAR) AS success,
  CASE WHEN coalesce(c > 0, false) THEN NULL ELSE 'insufficient credit' END AS error
FROM (SELECT event_id AS message_id,
        CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE value END AS c FROM events)""",
    }


def statements() -> dict[str, str]:
    general, partner = _case("general_ledger_detail"), _case("partner_ledger_detail")
    amounts = ["debit", "credit", "balance", *AGES]
    return {
        **{f"report_objects_{kind}": _objects(kind) for kind in OBJECTS},
        "match_dates": statement(f"""
SELECT full_reconcile_id, CAST(max(date) AS VARCHAR) AS last_match_date,
  CAST(bool_or(date >= DATE '{general.date_from}') AS VARCHAR) AS reaches_start,
  CAST(bool_or(date > DATE '{general.date_to}') AS VARCHAR) AS reaches_past_end
FROM item WHERE full_reconcile_id IS NOT NULL GROUP BY full_reconcile_id"""),
        "move_lines": statement("""
SELECT journal_id, account_id, count(*) AS n, CAST(sum(debit) AS DOUBLE) AS debit,
  CAST(sum(credit) AS DOUBLE) AS credit, CAST(max(date) AS VARCHAR) AS date
FROM item WHERE display_type IS NULL AND journal_id IN (1, 3) GROUP BY journal_id, account_id"""),
        "enriched_items": statement("""
SELECT ttp AS type_third_parties, CAST(iib AS VARCHAR) AS include_initial_balance,
  state AS parent_state, move_name[1:4] AS prefix, count(*) AS n, CAST(sum(balance) AS DOUBLE) AS balance
FROM item JOIN account c ON c.id = account_id GROUP BY ALL"""),
        "eligible_partners": statement(
            "SELECT id, ref, name FROM partner WHERE is_company OR parent_id IS NULL"),
        "account_group_subtree": statement("""
SELECT root AS group_id, CAST(sum(debit) AS DOUBLE) AS debit, CAST(sum(credit) AS DOUBLE) AS credit
FROM item JOIN account c ON c.id = account_id JOIN (
  SELECT CAST(g.id AS BIGINT) AS root, g.id AS member FROM acc_group g
  UNION ALL SELECT u.id, g.id FROM acc_group g JOIN acc_group u ON u.id = g.parent
  UNION ALL SELECT v.id, g.id FROM acc_group g JOIN acc_group u ON u.id = g.parent JOIN acc_group v ON v.id = u.parent
) ON member = grp GROUP BY root"""),
        "unaffected_earnings": _unaffected("general_ledger_detail"),
        "unaffected_earnings_net": _unaffected("general_ledger_net"),
        "opening_account": _opening("general_ledger_detail"),
        "opening_account_net": _opening("general_ledger_net"),
        "opening_account_compact": _opening("general_ledger_compact"),
        "opening_partner": _opening("partner_ledger_detail"),
        "opening_per_object": statement(
            "SELECT k AS report_object_id, CAST(sum(balance) AS DOUBLE) AS balance FROM opening GROUP BY k",
            report(general)),
        **{name: lines_sql(_case(name)) for name in CASES},
        **{f"{name}_joined": lines_sql(_case(name)) for name in JOINED},
        "object_totals": statement(
            shown(["report_object_id", *amounts, "cumul_balance"], "totals"), report(general)),
        "grand_total": statement(shown([*amounts, "cumul_balance"], "grand"), report(partner)),
        "lines_grouped": _grouped("account_id", "general_ledger_detail"),
        "lines_grouped_partner": _grouped("partner_id", "partner_ledger_detail"),
        "listing_footer": _footer("general_ledger_detail", ["debit", "credit"]),
        "listing_footer_aged": _footer("aged_balance_detail", [*AGES, "balance"]),
        "lines_search": _search("upper(move_name) LIKE '%RCV/1%' AND state = 'posted'"),
        "lines_search_drafts": _search("state = 'draft' AND journal_id = 1 AND ttp = 'customer'"),
        "lines_search_unreconciled": _search(
            "full_reconcile_id IS NULL AND balance <> 0 AND reconcile AND ttp = 'supplier' AND line_type = '2_line'"),
        "matching_labels": statement(
            'SELECT line_type, move_line_id, code, name, partner_name, matching_number '
            "FROM labelled WHERE line_type IN ('1_init_line', '2_line')",
            report(partner), labelled(partner)),
        "pivot_export": _pivot("general_ledger_compact"),
        "pivot_export_analytic": _pivot("analytic_ledger_detail"),
        "aged_pivot_export": _pivot("aged_balance_detail"),
        "section_export": _sections("partner_ledger_detail"),
        "section_export_analytic": _sections("analytic_ledger_detail"),
        "aged_section_export": _sections("aged_balance_detail"),
        "summary_export": _summary("general_ledger_trial_balance"),
        "aged_summary_export": _summary("aged_balance_summary"),
        "statement_export": _statement("general_ledger_compact"),
        "statement_export_summary": _statement("journal_ledger_trial_balance"),
        "aged_statement_export": _statement("aged_balance_detail"),
        "sheet_totals": statement("""
SELECT report_object_id, CAST(grouping(report_object_id) = 1 AS VARCHAR) AS is_sheet,
  CAST(sum(debit) AS DOUBLE) AS debit, CAST(sum(credit) AS DOUBLE) AS credit
FROM body GROUP BY ROLLUP (report_object_id)""", report(partner)),
        "pivot_export_three_decimals": _pivot("general_ledger_compact", tenth=True),
        "section_export_three_decimals": _sections("partner_ledger_detail", tenth=True),
        "aged_summary_export_three_decimals": _summary("aged_balance_summary", tenth=True),
        "general_trial_balance_three_decimals": lines_sql(
            _case("general_ledger_trial_balance"), tenth=True),
        "ordered_export": statement("""
SELECT row_number() OVER (ORDER BY object_name NULLS FIRST, report_object_id NULLS FIRST, line_type,
    date NULLS FIRST, move_line_id NULLS FIRST) AS position,
  object_name, line_type, CAST(date AS VARCHAR) AS date, move_line_id FROM labelled""",
            report(general), labelled(general)),
        "stamped_lines": statement("""
SELECT CAST(7 AS BIGINT) AS report_id, line_type, move_line_id, journal_id, CAST(debit AS DOUBLE) AS debit,
  CAST(1 AS BIGINT) AS company_currency_id, CAST(42 AS BIGINT) AS create_uid,
  '1998-12-31 12:00:00' AS create_date FROM lines""", report(_case("journal_ledger_detail"))),
        **_fiscal(),
        **_options(),
        "multi_report_trial_balance": _multi(),
        "multi_report_detail": _multi_detail(),
        "reports_side_by_side": _side_by_side(SIDE_BY_SIDE),
        "stored_report_lines": _side_by_side(STORED),
        **_outbound(),
    }
