"""The same questions in plain SQL, for checking against an independent engine.

``CTES`` holds named building blocks over the test tables, written the wide, literal way (as-of
join, one join per horizon, window dedupe) rather than the way the Spark jobs compute.
"""

from __future__ import annotations

import re

from tidemark.schemas import HORIZONS

CTES: dict[str, str] = {}

CTES["sub"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS ACCESSION_NUMBER,
  CASE WHEN o_orderkey % 97 = 0 THEN 'junk' ELSE upper(strftime(o_orderdate, '%d-%b-%Y')) END AS FILING_DATE,
  upper(strftime(o_orderdate - INTERVAL 4 DAY, '%d-%b-%Y')) AS PERIOD_OF_REPORT,
  CASE o_orderpriority WHEN '5-LOW' THEN '4/A' WHEN '4-NOT SPECIFIED' THEN '3' ELSE '4' END AS DOCUMENT_TYPE,
  lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS ISSUERCIK,
  c_name AS ISSUERNAME,
  CASE WHEN o_custkey % 28 < 25 THEN 'BR' || chr(CAST(65 + o_custkey % 28 AS INTEGER))
       WHEN o_custkey % 28 = 25 THEN NULL WHEN o_custkey % 28 = 26 THEN '' ELSE 'X-1' END AS ISSUERTRADINGSYMBOL,
  CASE o_orderkey % 8 WHEN 0 THEN '1' WHEN 1 THEN ' TRUE ' WHEN 2 THEN 't' WHEN 3 THEN 'false' WHEN 4 THEN '0' END AS AFF10B5ONE
FROM orders JOIN customer ON o_custkey = c_custkey"""

CTES["own"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS ACCESSION_NUMBER, CAST(l_suppkey AS VARCHAR) AS RPTOWNERCIK,
  s_name AS RPTOWNERNAME,
  CASE s_suppkey % 6 WHEN 0 THEN 'Director' WHEN 1 THEN 'Officer' WHEN 2 THEN 'Director,Officer'
    WHEN 3 THEN 'TenPercentOwner' WHEN 4 THEN 'Other' END AS RPTOWNER_RELATIONSHIP,
  CASE s_suppkey % 4 WHEN 1 THEN 'CEO' WHEN 2 THEN 'CFO' WHEN 3 THEN 'VP' END AS RPTOWNER_TITLE
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey"""

CTES["trn"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS ACCESSION_NUMBER, CAST(l_linenumber AS BIGINT) AS NONDERIV_TRANS_SK,
  upper(strftime(l_shipdate, '%d-%b-%Y')) AS TRANS_DATE,
  CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'N' THEN 'S' WHEN 'R' THEN 'M' END AS TRANS_CODE,
  l_quantity AS TRANS_SHARES,
  CASE WHEN l_tax = 0 AND l_linenumber = 1 THEN 0.0 ELSE l_extendedprice / l_quantity END AS TRANS_PRICEPERSHARE,
  CASE WHEN l_discount = 0.05 THEN 'F1' END AS TRANS_PRICEPERSHARE_FN,
  CASE l_linestatus WHEN 'O' THEN 'A' WHEN 'F' THEN 'D' END AS TRANS_ACQUIRED_DISP_CD,
  l_quantity * 10 AS SHRS_OWND_FOLWNG_TRANS,
  CASE WHEN l_partkey % 2 = 0 THEN 'D' ELSE 'I' END AS DIRECT_INDIRECT_OWNERSHIP
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_suppkey, l_partkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax,
                 l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1"""

CTES["notes"] = """
SELECT CAST(doc_id // 2 AS VARCHAR) AS ACCESSION_NUMBER,
  CASE WHEN doc_id % 5 = 0 THEN text || ' adopted under Rule 10B5-1 plan' ELSE text END AS FOOTNOTE_TXT
FROM documents"""

CTES["lines"] = """
SELECT l_partkey, l_quantity, CAST(l_shipdate AS DATE) AS date, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
FROM lineitem WHERE isodow(l_shipdate) < 6"""

CTES["px"] = """
SELECT 'BR' || chr(CAST(64 + CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS INTEGER)) AS ticker, date,
  min(cents) / 100.0::DOUBLE AS open, CAST(sum(cents) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS close,
  sum(l_quantity) AS volume
FROM lines JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""

CTES["bench"] = """
SELECT date, CAST(sum(cents) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS close, min(cents) / 100.0::DOUBLE AS open FROM lines GROUP BY 1"""

CTES["cal"] = """
SELECT row_number() OVER (ORDER BY date) - 1 AS t, date AS cal_date FROM (SELECT DISTINCT date FROM bench)"""

CTES["delist"] = """
SELECT * FROM (VALUES ('BRX', DATE '1997-03-03', 20000.0::DOUBLE), ('BRX', DATE '1999-06-01', 0.0::DOUBLE),
  ('BRX', DATE '1999-06-01', 50000.0::DOUBLE), ('BRY', DATE '2000-01-03', 10000.0::DOUBLE))
  AS d(ticker, delist_date, recovery_value)"""

CTES["delist_days"] = """
SELECT ticker, delist_date, min(recovery_value) AS recovery_value FROM delist GROUP BY 1, 2"""

CTES["sizes"] = """
SELECT CAST(c_custkey AS VARCHAR) AS issuer_cik, DATE '1995-01-01' AS effective_date, c_acctbal AS market_cap FROM customer
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), DATE '1998-07-01', c_acctbal * 2 FROM customer"""

CTES["flat_all"] = """
SELECT s.ACCESSION_NUMBER AS accession, FILING_DATE AS filing_date_raw, PERIOD_OF_REPORT AS period_raw,
  DOCUMENT_TYPE AS document_type, CAST(CAST(ISSUERCIK AS BIGINT) AS VARCHAR) AS issuer_cik, ISSUERNAME AS issuer_name,
  ISSUERTRADINGSYMBOL AS ticker, AFF10B5ONE AS aff10b5one, CAST(CAST(RPTOWNERCIK AS BIGINT) AS VARCHAR) AS insider_id,
  RPTOWNERNAME AS insider_name, RPTOWNER_RELATIONSHIP AS relationship, RPTOWNER_TITLE AS title,
  NONDERIV_TRANS_SK AS txn_sk, TRANS_DATE AS txn_date_raw, TRANS_CODE AS txn_code, TRANS_SHARES AS shares,
  TRANS_PRICEPERSHARE AS price, TRANS_PRICEPERSHARE_FN AS price_fn, TRANS_ACQUIRED_DISP_CD AS ad,
  SHRS_OWND_FOLWNG_TRANS AS shares_owned_following, DIRECT_INDIRECT_OWNERSHIP AS direct_indirect
FROM sub s JOIN own o ON s.ACCESSION_NUMBER = o.ACCESSION_NUMBER JOIN trn t ON s.ACCESSION_NUMBER = t.ACCESSION_NUMBER
WHERE TRANS_CODE = 'P' AND TRANS_ACQUIRED_DISP_CD = 'A'"""

CTES["flat"] = "SELECT * FROM flat_all WHERE document_type IN ('4')"

CTES["note_hits"] = """
SELECT ACCESSION_NUMBER AS accession, regexp_matches(string_agg(FOOTNOTE_TXT, ' '), '(?i)10b5-1') AS planned_note
FROM notes GROUP BY 1"""

_TYPED = """
SELECT f.*, CAST(try_strptime(filing_date_raw, '%d-%b-%Y') AS DATE) AS filing_date,
  CAST(try_strptime(txn_date_raw, '%d-%b-%Y') AS DATE) AS txn_date,
  CAST(try_strptime(period_raw, '%d-%b-%Y') AS DATE) AS period_of_report,
  shares * price AS value, price_fn IS NOT NULL AS price_footnoted,
  coalesce(lower(trim(aff10b5one)) IN ('1', 'true', 't', 'yes', 'y'), false){notes} AS is_10b5_1,
  lower(coalesce(relationship, '')) LIKE '%director%' AS is_director,
  lower(coalesce(relationship, '')) LIKE '%officer%' AS is_officer,
  lower(coalesce(relationship, '')) LIKE '%tenpercent%' AS is_ten_percent_owner,
  lower(coalesce(relationship, '')) LIKE '%other%' AS is_other
FROM flat f{join}"""

CTES["typed"] = _TYPED.format(
    notes=" OR coalesce(planned_note, false)",
    join=" LEFT JOIN note_hits h ON f.accession = h.accession",
)
CTES["typed_noscan"] = _TYPED.format(notes="", join="")

_COLLAPSE = """
SELECT accession, txn_sk, issuer_cik, issuer_name, ticker, document_type, filing_date, txn_date, period_of_report,
  txn_code, shares, price, price_footnoted, value, shares_owned_following, direct_indirect, is_10b5_1,
  insider_id, insider_name, relationship, first_title AS title, any_director AS is_director,
  any_officer AS is_officer, any_ten AS is_ten_percent_owner, any_other AS is_other,
  CAST(n AS BIGINT) AS n_reporting_owners
FROM (SELECT *, row_number() OVER o AS rn, first_value(title IGNORE NULLS) OVER w AS first_title,
        bool_or(is_director) OVER p AS any_director, bool_or(is_officer) OVER p AS any_officer,
        bool_or(is_ten_percent_owner) OVER p AS any_ten, bool_or(is_other) OVER p AS any_other,
        count(*) OVER p AS n
      FROM {src}
      WINDOW p AS (PARTITION BY accession, txn_sk),
        o AS (PARTITION BY accession, txn_sk ORDER BY insider_id NULLS FIRST, insider_name NULLS FIRST, relationship NULLS FIRST, title NULLS FIRST),
        w AS (PARTITION BY accession, txn_sk ORDER BY insider_id NULLS FIRST, insider_name NULLS FIRST, relationship NULLS FIRST, title NULLS FIRST
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE rn = 1"""

CTES["all_events"] = _COLLAPSE.format(src="typed")
CTES["all_events_noscan"] = _COLLAPSE.format(src="typed_noscan")
CTES["ev"] = "SELECT * FROM all_events WHERE NOT coalesce(is_10b5_1, false)"
CTES["elig"] = "SELECT * FROM ev WHERE ticker IS NOT NULL AND length(ticker) > 0 AND regexp_matches(ticker, '^[A-Za-z.]+$')"
CTES["entry"] = """
SELECT e.accession, e.txn_sk, e.ticker, e.filing_date, c.t AS entry_t, c.cal_date AS entry_date
FROM elig e ASOF LEFT JOIN cal c ON e.filing_date <= c.cal_date"""


CTES["entry_next"] = """
SELECT e.* REPLACE (c.t AS entry_t, c.cal_date AS entry_date) FROM entry e LEFT JOIN cal c ON c.t = e.entry_t + 1"""


def _wide_panel(source: str, delisted: bool = False, field: str = "close") -> str:
    joins, cols = [], []
    for h, n in HORIZONS.items():
        joins.append(
            f"LEFT JOIN cal x{h} ON x{h}.t = e.entry_t + {n} "
            f"LEFT JOIN px p{h} ON p{h}.ticker = e.ticker AND p{h}.date = x{h}.cal_date "
            f"LEFT JOIN bench b{h} ON b{h}.date = x{h}.cal_date"
        )
        ret = f"p{h}.close / nullif(p0.{field}, 0) - 1.0"
        if delisted:
            ret = (
                f"CASE WHEN p0.close IS NOT NULL "
                f"AND d.delist_date <= x{h}.cal_date THEN d.recovery_value / p0.close - 1.0 ELSE {ret} END"
            )
        cols.append(f"({ret}) AS ret_{h}")
        cols.append(f"({ret}) - (b{h}.close / b0.{field} - 1.0) AS abn_{h}")
        cols.append(f"x{h}.cal_date AS exit_date_{h}")
    extra = " ASOF LEFT JOIN delist_days d ON d.ticker = e.ticker AND e.entry_date < d.delist_date" if delisted else ""
    return (
        f"SELECT e.*, p0.{field} AS entry_close, p0.{field} IS NOT NULL AS priced, "
        + ", ".join(cols)
        + f" FROM {source} e LEFT JOIN px p0 ON p0.ticker = e.ticker AND p0.date = e.entry_date"
        + " LEFT JOIN bench b0 ON b0.date = e.entry_date "
        + " ".join(joins)
        + extra
    )


CTES["wide"] = _wide_panel("entry")
CTES["wide_next"] = _wide_panel("entry_next", field="open")
CTES["wide_delisted"] = _wide_panel("entry", delisted=True)
CTES["long"] = " UNION ALL ".join(
    f"SELECT accession, txn_sk, '{h}' AS horizon, abn_{h} AS abn FROM wide" for h in HORIZONS
)
CTES["horizons"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{h}', {n})" for h, n in HORIZONS.items())
    + ") AS h(horizon, steps)"
)


def with_ctes(body: str, **extra: str) -> str:
    """The body behind every building block it mentions, directly or through another."""
    blocks = {**CTES, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text))
        for name in blocks:
            if name in words and name not in needed:
                visit(blocks[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ",\n".join(f"{name} AS ({blocks[name]})" for name in needed)
    return f"WITH {head}\n{body}" if head else body
