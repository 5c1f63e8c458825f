"""DuckDB SQL for the expected result of each registered query.

Written from the meaning of each operator, in a shape of its own: money as one
list of entries per platform, counts as filtered aggregates over each table,
labels looked up by key. The Spark operators use pre-aggregation and
top-k-before-join, so the two check each other. Expected texts and default rows
are written out here and not taken from the code under test. All texts run on
the driver's Parquet views (nation, customer, orders, lineitem) and derive the
four tables with the bindings of FIXTURES.md.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2000-01-01'"

BINDINGS = f"""
platforms AS (
  SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name, substr(n_name, 1, 1) AS icon,
         '#0000' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS color,
         CAST(4 + n_nationkey % 8 AS INTEGER) AS max_profiles,
         DATE '1994-01-01' + CAST(n_nationkey AS INTEGER) AS created_on
  FROM nation
),
accounts AS (
  SELECT c_custkey AS id, CAST(CASE WHEN c_nationkey = 24 THEN 23 ELSE c_nationkey END AS INTEGER) AS platform_id,
         'cust' || CAST(c_custkey AS VARCHAR) || '@mail.example' AS email,
         c_mktsegment AS provider_name,
         CAST(abs(c_acctbal) AS DECIMAL(10,2)) AS cost,
         CASE WHEN c_custkey % 10 = 3 THEN NULL
              ELSE {AS_OF} + CAST(c_custkey % 61 - 20 AS INTEGER) END AS expiry_date,
         DATE '1995-01-01' + CAST(c_custkey % 700 AS INTEGER) AS created_on
  FROM customer
),
profiles AS (
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 7 THEN o_custkey - 1 ELSE o_custkey END AS account_id,
         'P' || CAST(o_orderkey AS VARCHAR) AS profile_name,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE 'Client ' || CAST(o_custkey AS VARCHAR) END AS client_name,
         CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '+54 (11) ' || CAST(10000000 + o_orderkey AS VARCHAR) END AS client_whatsapp,
         CASE WHEN o_orderkey % 25 = 0 THEN CAST(0 AS DECIMAL(10,2)) ELSE CAST(o_totalprice AS DECIMAL(10,2)) END AS sale_price,
         CASE WHEN o_orderkey % 8 = 5 THEN NULL
              ELSE {AS_OF} + CAST(o_orderkey % 91 - 30 AS INTEGER) END AS expiry_date,
         o_orderstatus <> 'F' AS is_active,
         o_orderdate AS created_at
  FROM orders
),
renewals AS (
  SELECT CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_orderkey % 9 = 0 THEN -l_orderkey ELSE l_orderkey END AS profile_id,
         CASE WHEN o_custkey % 50 = 0 THEN -o_custkey ELSE o_custkey END AS account_id,
         CAST(CASE WHEN c_nationkey = 24 THEN 99 ELSE c_nationkey END AS INTEGER) AS platform_id,
         'old' || CAST(o_custkey AS VARCHAR) || '@mail.example' AS account_email,
         'Old ' || CAST(c_nationkey AS VARCHAR) AS platform_name,
         CASE WHEN l_returnflag = 'A' THEN '' ELSE 'OldP' || CAST(l_orderkey AS VARCHAR) END AS profile_name,
         CASE WHEN l_returnflag = 'A' THEN '' ELSE 'Old Client ' || CAST(o_custkey AS VARCHAR) END AS client_name,
         CASE WHEN l_returnflag = 'A' THEN '' ELSE '+54 9 ' || CAST(20000000 + l_orderkey AS VARCHAR) END AS client_whatsapp,
         'o' AS platform_icon,
         '#ffffff' AS platform_color,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS old_expiry_date,
         CAST(l_shipdate AS DATE) + 30 AS new_expiry_date,
         CASE WHEN l_linenumber = 7 THEN CAST(0 AS DECIMAL(10,2)) ELSE CAST(l_extendedprice AS DECIMAL(10,2)) END AS sale_price,
         CASE WHEN l_returnflag = 'A' THEN 'account' ELSE 'profile' END AS renewal_type,
         l_shipdate AS created_at,
         CAST(l_linenumber AS INTEGER) AS l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)
"""

_EXPIRED = "coalesce({d} <= " + AS_OF + ", false)"
_SOON = "coalesce({d} BETWEEN " + AS_OF + " + 1 AND " + AS_OF + " + 7, false)"


def expired(d: str) -> str:
    return _EXPIRED.format(d=d)


def soon(d: str) -> str:
    return _SOON.format(d=d)


def with_bindings(body: str) -> str:
    """Prefix a SELECT with the four table bindings as CTEs."""
    return "WITH " + BINDINGS + "\n" + body


M = "DECIMAL(38,2)"

# ------------------------------------------------------------------ reports
# every amount as an entry of its platform; the first line makes sure of a row for each
_ENTRIES = """
  SELECT id AS platform_id, NULL AS held, NULL AS sold, 0 AS spent, 0 AS earned FROM platforms
  UNION ALL SELECT platform_id, id, NULL, cost, 0 FROM accounts
  UNION ALL SELECT holder.platform_id, NULL, CASE WHEN item.is_active THEN item.id END, 0, item.sale_price
            FROM profiles AS item, accounts AS holder WHERE item.account_id = holder.id
  UNION ALL SELECT platform_id, NULL, NULL, CASE renewal_type WHEN 'account' THEN sale_price END,
                   CASE renewal_type WHEN 'profile' THEN sale_price END FROM renewals
"""

PLATFORM_REPORT = f"""
SELECT id, name, icon, color, sums.* EXCLUDE (platform_id), CAST(total_revenue - total_cost AS {M}) AS profit
FROM platforms, (
  SELECT platform_id, count(held) AS account_count, count(sold) AS profile_count,
         CAST(sum(spent) AS {M}) AS total_cost, CAST(sum(earned) AS {M}) AS total_revenue
  FROM ({_ENTRIES}) GROUP BY platform_id) AS sums
WHERE sums.platform_id = platforms.id
ORDER BY profit DESC
"""

SUMMARY = f"""
SELECT offered.n AS total_platforms, held.n AS total_accounts, sold.live AS total_profiles, sold.named AS active_clients,
       held.cost + book.cost AS total_costs, sold.income + book.income AS total_revenue,
       sold.late AS expired_profiles, sold.due AS expiring_soon_profiles,
       held.late AS expired_accounts, held.due AS expiring_soon_accounts,
       CAST(sold.income + book.income - held.cost - book.cost AS {M}) AS total_profit,
       sold.due + held.due AS expiring_soon_total,
       sold.income + book.income >= held.cost + book.cost AS profit_non_negative
FROM (SELECT count(*) AS n FROM platforms) AS offered,
     (SELECT count(*) AS n, CAST(ifnull(sum(cost), 0) AS {M}) AS cost,
             count(*) FILTER ({expired('expiry_date')}) AS late, count(*) FILTER ({soon('expiry_date')}) AS due FROM accounts) AS held,
     (SELECT count(*) FILTER (is_active) AS live, count(*) FILTER (is_active AND length(client_name) > 0) AS named,
             CAST(ifnull(sum(sale_price), 0) AS {M}) AS income,
             count(*) FILTER (is_active AND {expired('expiry_date')}) AS late,
             count(*) FILTER (is_active AND {soon('expiry_date')}) AS due FROM profiles) AS sold,
     (SELECT CAST(ifnull(sum(sale_price) FILTER (renewal_type = 'account'), 0) AS {M}) AS cost,
             CAST(ifnull(sum(sale_price) FILTER (renewal_type = 'profile'), 0) AS {M}) AS income FROM renewals) AS book
"""

# Counts per account first. An account's date counts once for each of its
# profiles, and once without any.
_PER_ACCOUNT = f"""
  SELECT account_id, count(*) AS n, count_if({expired('expiry_date')}) AS late, count_if({soon('expiry_date')}) AS due
  FROM profiles GROUP BY account_id
"""


def _stats(times: str) -> str:
    return f"""
SELECT id,
       CAST(ifnull(sum({times}) FILTER (WHERE acc_late), 0) AS BIGINT) AS expired_accounts,
       CAST(ifnull(sum({times}) FILTER (WHERE acc_due), 0) AS BIGINT) AS expiring_soon_accounts,
       CAST(ifnull(sum(late), 0) AS BIGINT) AS expired_profiles, CAST(ifnull(sum(due), 0) AS BIGINT) AS expiring_soon_profiles
FROM (SELECT id FROM platforms) AS every
LEFT JOIN (
  SELECT platform_id, {expired('expiry_date')} AS acc_late, {soon('expiry_date')} AS acc_due, n, late, due
  FROM accounts LEFT JOIN ({_PER_ACCOUNT}) AS own ON own.account_id = accounts.id) AS seats ON seats.platform_id = every.id
GROUP BY id
"""


_STATS = _stats("greatest(ifnull(n, 0), 1)")

PLATFORM_EXPIRY_STATS = _STATS

PLATFORM_EXPIRY_STATS_DISTINCT = _stats("1")


def platform_list_sql(where: str = "") -> str:
    """``where`` may name a platform as p.id."""
    return f"""
SELECT p.*, ifnull(held.n, 0) AS account_count, ifnull(sold.n, 0) AS profile_count, stats.* EXCLUDE (id)
FROM platforms AS p
JOIN ({_STATS}) AS stats ON stats.id = p.id
LEFT JOIN (SELECT platform_id, count(*) AS n FROM accounts GROUP BY ALL) AS held ON held.platform_id = p.id
LEFT JOIN (SELECT platform_id, CAST(sum(n) AS BIGINT) AS n FROM ({_PER_ACCOUNT}) AS own JOIN accounts ON accounts.id = own.account_id
           GROUP BY ALL) AS sold ON sold.platform_id = p.id
{where}
ORDER BY p.created_on DESC NULLS FIRST
"""


PLATFORM_ALERTS = f"""
SELECT platform_id, kind, n,
  CASE WHEN kind IN ('expired_accounts', 'expired_profiles') THEN 'expired' ELSE 'warning' END AS severity,
  CASE kind
    WHEN 'expired_accounts' THEN '🔴 ' || n || ' cuenta(s) vencida(s)'
    WHEN 'expiring_soon_accounts' THEN '🟡 ' || n || ' cuenta(s) por vencer'
    WHEN 'expired_profiles' THEN '🔴 ' || n || ' perfil(es) vencido(s)'
    ELSE '🟡 ' || n || ' perfil(es) por vencer' END AS text
FROM (
  SELECT id AS platform_id, 'expired_accounts' AS kind, expired_accounts AS n FROM ({_STATS})
  UNION ALL SELECT id, 'expiring_soon_accounts', expiring_soon_accounts FROM ({_STATS})
  UNION ALL SELECT id, 'expired_profiles', expired_profiles FROM ({_STATS})
  UNION ALL SELECT id, 'expiring_soon_profiles', expiring_soon_profiles FROM ({_STATS})
) WHERE n > 0
"""


# what a platform lends to the rows below it
_BRAND = "SELECT id AS platform_id, name AS platform_name, icon AS platform_icon, color AS platform_color FROM platforms"
# an account as the profiles' owner
_OWNER = "SELECT id AS account_id, email AS account_email, cost AS account_cost, platform_id FROM accounts"


def _pair_sql(due: str) -> str:
    """Both kinds by name; what one lacks stays null."""
    return f"""
SELECT * FROM (
  SELECT 'account' AS type, id, email, expiry_date, platform_name, platform_icon, platform_color
  FROM accounts JOIN ({_BRAND}) USING (platform_id) WHERE {due}
  UNION ALL BY NAME
  SELECT 'profile' AS type, id, account_email, expiry_date, platform_name, platform_icon, platform_color, profile_name, client_name
  FROM profiles JOIN ({_OWNER}) USING (account_id) JOIN ({_BRAND}) USING (platform_id) WHERE is_active AND {due})
"""


EXPIRING_SOON = _pair_sql(soon("expiry_date"))
EXPIRED = _pair_sql(expired("expiry_date"))


def expiring_within_sql(days: int) -> str:
    due = f"expiry_date - {AS_OF} <= {days}"
    return f"""
SELECT 'account' AS type, accounts.*, brand.* EXCLUDE (platform_id)
FROM accounts JOIN ({_BRAND}) AS brand USING (platform_id) WHERE {due}
UNION ALL BY NAME
SELECT 'profile' AS type, profiles.*, account_email, brand.* EXCLUDE (platform_id)
FROM profiles JOIN ({_OWNER}) USING (account_id) JOIN ({_BRAND}) AS brand USING (platform_id) WHERE is_active AND {due}
"""


def expiring_within_counts_sql(days: int) -> str:
    return f"SELECT type, COUNT(*) AS n FROM ({expiring_within_sql(days)}) GROUP BY type"


PLATFORM_REPORT_TOTAL = f"""
SELECT id, name, account_count, profile_count, total_cost, total_revenue, profit,
       false AS is_total, profit >= 0 AS profit_non_negative
FROM ({PLATFORM_REPORT})
UNION ALL
SELECT NULL, 'Total', CAST(SUM(account_count) AS BIGINT), CAST(SUM(profile_count) AS BIGINT),
       CAST(SUM(total_cost) AS {M}), CAST(SUM(total_revenue) AS {M}), CAST(SUM(profit) AS {M}),
       true, SUM(profit) >= 0
FROM ({PLATFORM_REPORT})
"""

# ------------------------------------------------------------------- lists
# what the active profiles and the log bring in for each account
_INCOME = """
  SELECT account_id, CAST(sum(seat) AS BIGINT) AS seats, sum(amount) AS amount
  FROM (SELECT account_id, 1 AS seat, sale_price AS amount FROM profiles WHERE is_active
        UNION ALL SELECT account_id, 0, sale_price FROM renewals WHERE renewal_type = 'profile')
  GROUP BY account_id
"""
_EARNING = "ifnull(seats, 0) AS profile_count, CAST(ifnull(amount, 0) AS DECIMAL(38,2)) AS total_revenue"


def account_list_sql(platform_id: int | None) -> str:
    only = "true" if platform_id is None else f"platform_id = {int(platform_id)}"
    return f"""
SELECT accounts.*, {_EARNING}
FROM accounts LEFT JOIN ({_INCOME}) AS income ON income.account_id = accounts.id
WHERE {only} ORDER BY created_on DESC NULLS FIRST
"""


def account_detail_sql(account_id: int) -> str:
    return f"""
SELECT chosen.*, brand.* EXCLUDE (platform_id), {_EARNING}
FROM (SELECT * FROM accounts WHERE id = {int(account_id)}) AS chosen
JOIN ({_BRAND.replace(" FROM", ", max_profiles FROM")}) AS brand USING (platform_id)
LEFT JOIN ({_INCOME}) AS income ON income.account_id = chosen.id
"""


def profile_list_sql(where: str) -> str:
    """``where``: conditions on p, each followed by AND."""
    return f"""
SELECT p.*, account_email, account_cost, platform_name, platform_icon, platform_color
FROM profiles AS p JOIN ({_OWNER}) USING (account_id) JOIN ({_BRAND}) USING (platform_id)
WHERE {where} p.is_active ORDER BY p.created_at DESC NULLS FIRST
"""


# ------------------------------------------------------------------ series
def _newest(table: str, label: str, name: str, count: str, amount: str, only: str, n: int) -> str:
    """Count and amount by label, the newest ``n`` labels."""
    return f"""
SELECT label AS {name}, count(*) AS {count}, CAST(ifnull(sum(sale_price), 0) AS {M}) AS {amount}
FROM (SELECT {label} AS label, sale_price FROM {table} WHERE {only})
GROUP BY label ORDER BY label DESC NULLS FIRST LIMIT {n}
"""


_DAY, _MONTH = "CAST(created_at AS DATE)", "strftime(created_at, '%Y-%m')"
SALES_DAILY = _newest("profiles", _DAY, "date", "profiles_sold", "revenue", "sale_price > 0", 30)
RENEWALS_DAILY = _newest("renewals", _DAY, "date", "renewals_count", "renewal_revenue", "sale_price > 0", 30)
MONTHLY = _newest("renewals", _MONTH, "month", "renewal_count", "revenue", "true", 12)

MONTHLY_BY_TYPE = f"""
SELECT month, renewal_type, n AS renewal_count, CAST(total AS {M}) AS revenue
FROM (SELECT *, dense_rank() OVER (ORDER BY month DESC NULLS FIRST) AS place
      FROM (SELECT {_MONTH} AS month, renewal_type, count(*) AS n, sum(sale_price) AS total FROM renewals GROUP BY ALL))
WHERE place <= 12
"""

_R_COLS = [
    "profile_id",
    "account_id",
    "platform_id",
    "account_email",
    "platform_name",
    "profile_name",
    "client_name",
    "client_whatsapp",
    "platform_icon",
    "platform_color",
    "old_expiry_date",
    "new_expiry_date",
    "sale_price",
    "renewal_type",
    "created_at",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
]


# log column -> (live table, its key in the log, its column)
_LIVE_LABELS = {
    "profile_name": ("profiles", "profile_id", "profile_name"),
    "client_name": ("profiles", "profile_id", "client_name"),
    "client_whatsapp": ("profiles", "profile_id", "client_whatsapp"),
    "account_email": ("accounts", "account_id", "email"),
    "platform_name": ("platforms", "platform_id", "name"),
    "platform_icon": ("platforms", "platform_id", "icon"),
    "platform_color": ("platforms", "platform_id", "color"),
}


def renewal_history_sql(date_from: str | None, date_to: str | None, limit: int | None) -> str:
    """The page of the log first; then each label by key, the snapshot where no live row is."""
    first, last = date_from or "0001-01-01", f"{date_to or '9999-12-31'} 23:59:59"
    only = f"created_at BETWEEN TIMESTAMP '{first}' AND TIMESTAMP '{last}'" if date_from or date_to else "true"
    order = "created_at DESC NULLS FIRST, " + ", ".join(f"{c} NULLS FIRST" for c in _R_COLS if c != "created_at")
    page = f"SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM renewals WHERE {only}"
    cut = "true" if limit is None else f"place <= {int(limit)}"

    def shown(c: str) -> str:
        if c not in _LIVE_LABELS:
            return f"page.{c}"
        table, key, label = _LIVE_LABELS[c]
        return f"ifnull((SELECT live.{label} FROM {table} AS live WHERE live.id = page.{key}), page.{c}) AS {c}"

    return f"SELECT {', '.join(shown(c) for c in _R_COLS)} FROM ({page}) AS page WHERE {cut} ORDER BY place"


def renewal_history_total_sql(date_from, date_to, limit) -> str:
    return f"""
SELECT COUNT(*) AS count, CAST(COALESCE(SUM(sale_price), 0) AS {M}) AS total_revenue
FROM ({renewal_history_sql(date_from, date_to, limit)})
"""


# ---------------------------------------------------------- display texts
# Month names, the notice's rules and the default platforms.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


RULES = [
    "NO COMPARTIR LA CUENTA.",
    "RESPETAR LOS DEMAS PERFILES.",
    "NO CAMBIAR NADA EN LA CUENTA.",
    "NO ACTIVAR MIEMBRO EXTRA.",
    "USAR SOLO EN UN DISPOSITIVO.",
]
DEFAULT_PLATFORMS = """
  (1, 'Netflix', '🎬', '#E50914', 5),
  (2, 'Disney+', '🏰', '#113CCF', 7),
  (3, 'Prime Video', '📦', '#00A8E1', 6),
  (4, 'HBO Max', '🎭', '#B834DB', 5),
  (5, 'Spotify', '🎵', '#1DB954', 6)
"""


def months_list() -> str:
    return "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"


def long_date(d: str) -> str:
    return (
        f"CASE WHEN {d} IS NULL THEN 'Sin fecha' ELSE lpad(CAST(day({d}) AS VARCHAR), 2, '0') || ' de ' || "
        f"{months_list()}[month({d})] || ' de ' || CAST(year({d}) AS VARCHAR) END"
    )


def money_txt(x: str) -> str:
    return (
        f"'$' || CASE WHEN abs({x}) < 10000 THEN replace(printf('%.2f', {x}), '.', ',') "
        f"ELSE translate(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',.', '.,') END"
    )


def uri(x: str) -> str:
    e = f"url_encode({x})"
    for enc, raw in (("%21", "!"), ("%2A", "*"), ("%27", "''"), ("%28", "("), ("%29", ")")):
        e = f"replace({e}, '{enc}', '{raw}')"
    return e


def link(phone: str, msg: str) -> str:
    return f"'https://wa.me/' || regexp_replace({phone}, '[^0-9]', '', 'g') || '?text=' || {uri(msg)}"


def badge_sql(d: str) -> str:
    n = f"({d} - {AS_OF})"
    return f"""{n} AS days_left,
  CASE WHEN {d} IS NULL THEN 'no-date' WHEN {n} < 0 THEN 'expired' WHEN {n} = 0 THEN 'expired'
       WHEN {n} <= 3 THEN 'warning' ELSE 'active' END AS status_class,
  CASE WHEN {d} IS NULL THEN '📅' WHEN {n} < 0 THEN '🔴' WHEN {n} = 0 THEN '⚠️'
       WHEN {n} <= 3 THEN '🟡' ELSE '🟢' END AS status_icon,
  CASE WHEN {d} IS NULL THEN 'Sin fecha'
       WHEN {n} < 0 THEN 'Venció hace ' || CAST(abs({n}) AS VARCHAR) || ' día(s)'
       WHEN {n} = 0 THEN 'Vence hoy'
       WHEN {n} <= 3 THEN 'Vence en ' || CAST({n} AS VARCHAR) || ' día(s)'
       ELSE 'Vence en ' || CAST({n} AS VARCHAR) || ' días' END AS status_text"""


EXPIRY_BUCKETS = f"""
SELECT 'account' AS type, id, expiry_date, {badge_sql('expiry_date')} FROM accounts
UNION ALL
SELECT 'profile' AS type, id, expiry_date, {badge_sql('expiry_date')} FROM profiles WHERE is_active = true
"""

ACCOUNT_OCCUPANCY = """
SELECT a.id, a.platform_id, COUNT(CASE WHEN p.is_active = true THEN p.id END) AS profile_count, pl.max_profiles,
       least(100.0, (COUNT(CASE WHEN p.is_active = true THEN p.id END) / pl.max_profiles) * 100.0) AS occupancy_pct,
       COUNT(CASE WHEN p.is_active = true THEN p.id END) >= pl.max_profiles AS is_full
FROM accounts a JOIN platforms pl ON pl.id = a.platform_id LEFT JOIN profiles p ON p.account_id = a.id
GROUP BY a.id, a.platform_id, pl.max_profiles
"""

MONEY_TEXT = f"""
SELECT id, {money_txt('total_cost')} AS total_cost_text, {money_txt('total_revenue')} AS total_revenue_text,
       {money_txt('profit')} AS profit_text
FROM ({PLATFORM_REPORT})
"""

LONG_DATE_TEXT = f"SELECT id, expiry_date, {long_date('expiry_date')} AS expiry_text FROM profiles"


def renewal_display_sql(date_from, date_to, limit) -> str:
    return f"""
SELECT h.*,
  CASE WHEN renewal_type = 'account' THEN account_email ELSE profile_name END AS item_text,
  CASE WHEN renewal_type = 'account' THEN 'Cuenta' WHEN COALESCE(client_name, '') = '' THEN '—' ELSE client_name END AS who_text,
  CASE WHEN old_expiry_date IS NULL THEN '—' ELSE {long_date('old_expiry_date')} END AS old_date_text,
  {long_date('new_expiry_date')} AS new_date_text,
  {money_txt('sale_price')} AS price_text
FROM ({renewal_history_sql(date_from, date_to, limit)}) h
"""


# ------------------------------------------------------------------ outbox
_LIVE = """
SELECT p.*, a.email AS account_email, a.cost AS account_cost, pl.id AS platform_id, pl.name AS platform_name,
       pl.icon AS platform_icon, pl.color AS platform_color
FROM profiles p JOIN accounts a ON a.id = p.account_id JOIN platforms pl ON pl.id = a.platform_id
"""


def _reminder_msg() -> str:
    return (
        "'Hola *' || client_name || '*\nTe recuerdo que tu cuenta de *' || platform_name || '* vence en *' || "
        "CASE WHEN days_left = 1 THEN '1 día' ELSE CAST(days_left AS VARCHAR) || ' días' END || "
        "'*. Puedes renovar cuando gustes.\n\n¡Estamos para ayudarte!'"
    )


def _expiry_msg() -> str:
    return (
        "'Hola ' || client_name || '\nTu cuenta de *' || platform_name || "
        "'* vence *hoy*.\nPara no perder el acceso, por favor renueva lo antes posible. \n\n¡Gracias!'"
    )


def _outbox(msg: str, cond: str) -> str:
    return f"""
SELECT profile_id, account_id, client_whatsapp, days_left, message, {link('client_whatsapp', 'message')} AS link
FROM (
  SELECT id AS profile_id, account_id, client_whatsapp, days_left, {msg} AS message
  FROM (SELECT *, expiry_date - {AS_OF} AS days_left FROM ({_LIVE}) WHERE is_active = true AND client_whatsapp <> '')
  WHERE {cond}
)
"""


REMINDER_OUTBOX = _outbox(_reminder_msg(), "days_left > 0")
EXPIRY_OUTBOX = _outbox(_expiry_msg(), "days_left <= 0")


def renewal_msg(platform: str, email: str, profile: str, new_date: str) -> str:
    rule = "=" * 24
    rules = "*REGLAS:*\n" + "\n".join(f"{i}.- {x}" for i, x in enumerate(RULES, 1)) + "\n*¡GRACIAS POR SU PREFERENCIA! 🤗*"
    return (
        f"'*🔴' || upper({platform}) || '🔴*\n{rule}\n📧 *CORREO:* ' || {email} || "
        f"'\n🔑 *CONTRASEÑA:* ********\n🖥 *PERFIL:* ' || {profile} || '  *PIN:* Sin PIN\n{rule}\n📅 *VENCE: ' || "
        f"{long_date(new_date)} || '*\n{rule}\n{rules}'"
    )


# ----------------------------------------------------------------- changes
def _truthy_text(c: str) -> str:
    return f"({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '')"


def _truthy_num(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} <> 0)"


def _text_or(c: str, default: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN '{default}' ELSE {c} END"


def _num_or(c: str, default, typ: str) -> str:
    return f"CAST(CASE WHEN {c} IS NULL OR {c} = 0 THEN {default} ELSE {c} END AS {typ})"


def _new_id(table: str) -> str:
    return f"(SELECT COALESCE(max(id), 0) FROM {table}) + (seq - (SELECT min(seq) FROM req)) + 1"


def insert_platforms_sql(req: str, as_of: str) -> str:
    return f""", req AS ({req})
SELECT CAST({_new_id('platforms')} AS INTEGER) AS id, name, {_text_or('icon', '📺')} AS icon,
       {_text_or('color', '#6c5ce7')} AS color, {_num_or('max_profiles', 5, 'INTEGER')} AS max_profiles,
       {as_of} AS created_on
FROM req WHERE {_truthy_text('name')}
"""


def insert_accounts_sql(req: str, as_of: str) -> str:
    return f""", req AS ({req})
SELECT CAST({_new_id('accounts')} AS BIGINT) AS id, platform_id, email, {_text_or('provider_name', '')} AS provider_name,
       {_num_or('cost', 0, 'DECIMAL(10,2)')} AS cost, expiry_date, {as_of} AS created_on
FROM req
WHERE {_truthy_num('platform_id')} AND {_truthy_text('email')} AND {_truthy_text('password')}
  AND platform_id IN (SELECT id FROM platforms)
"""


def _profile_insert_select(now: str) -> str:
    return f"""CAST({_new_id('profiles')} AS BIGINT) AS id, account_id, profile_name, client_name,
       {_text_or('client_whatsapp', '')} AS client_whatsapp, {_num_or('sale_price', 0, 'DECIMAL(10,2)')} AS sale_price,
       expiry_date, true AS is_active, {now} AS created_at"""


def _profile_insert_valid() -> str:
    return (
        f"{_truthy_num('account_id')} AND {_truthy_text('profile_name')} AND {_truthy_text('client_name')} "
        "AND account_id IN (SELECT id FROM accounts)"
    )


def insert_profiles_sql(req: str, now: str) -> str:
    return f""", req AS ({req})
SELECT {_profile_insert_select(now)} FROM req WHERE {_profile_insert_valid()}
"""


def admit_within_capacity_sql(req: str, now: str) -> str:
    return f""", req AS ({req}),
ok AS (SELECT * FROM req WHERE {_profile_insert_valid()}),
pos AS (
  SELECT ok.*, ROW_NUMBER() OVER (PARTITION BY ok.account_id ORDER BY ok.seq) AS n,
         pl.max_profiles - (SELECT COUNT(*) FROM profiles p WHERE p.account_id = ok.account_id AND p.is_active = true) AS room
  FROM ok JOIN accounts a ON a.id = ok.account_id JOIN platforms pl ON pl.id = a.platform_id
)
SELECT {_profile_insert_select(now)} FROM pos WHERE n <= room
"""


def validate_changes_sql(req: str) -> str:
    return f""", req AS ({req})
SELECT *, {_truthy_num('account_id')} AND {_truthy_text('profile_name')} AND {_truthy_text('client_name')} AS valid
FROM req
"""


def update_platforms_sql(req: str) -> str:
    return f""", req AS ({req}),
win AS (
  SELECT * FROM req WHERE {_truthy_text('name')} AND id IN (SELECT id FROM platforms)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY seq DESC) = 1
)
SELECT p.id,
  CASE WHEN w.id IS NULL THEN p.name ELSE w.name END AS name,
  CASE WHEN w.id IS NULL THEN p.icon ELSE {_text_or('w.icon', '📺')} END AS icon,
  CASE WHEN w.id IS NULL THEN p.color ELSE {_text_or('w.color', '#6c5ce7')} END AS color,
  CASE WHEN w.id IS NULL THEN p.max_profiles ELSE {_num_or('w.max_profiles', 5, 'INTEGER')} END AS max_profiles,
  p.created_on
FROM platforms p LEFT JOIN win w ON w.id = p.id
"""


def update_accounts_sql(req: str, keep_expiry: bool) -> str:
    expiry = "COALESCE(w.kept_expiry, a.expiry_date)" if keep_expiry else "w.expiry_date"
    return f""", req AS ({req}),
ok AS (SELECT * FROM req WHERE {_truthy_text('email')} AND {_truthy_text('password')} AND id IN (SELECT id FROM accounts)),
win AS (
  SELECT o.*, (SELECT arg_max(k.expiry_date, k.seq) FROM ok k WHERE k.id = o.id AND k.expiry_date IS NOT NULL) AS kept_expiry
  FROM ok o QUALIFY ROW_NUMBER() OVER (PARTITION BY o.id ORDER BY o.seq DESC) = 1
)
SELECT a.id, a.platform_id,
  CASE WHEN w.id IS NULL THEN a.email ELSE w.email END AS email,
  CASE WHEN w.id IS NULL THEN a.provider_name ELSE {_text_or('w.provider_name', '')} END AS provider_name,
  CASE WHEN w.id IS NULL THEN a.cost ELSE {_num_or('w.cost', 0, 'DECIMAL(10,2)')} END AS cost,
  CASE WHEN w.id IS NULL THEN a.expiry_date ELSE {expiry} END AS expiry_date,
  a.created_on
FROM accounts a LEFT JOIN win w ON w.id = a.id
"""


def update_profiles_sql(req: str) -> str:
    return f""", req AS ({req}),
win AS (
  SELECT * FROM req
  WHERE {_truthy_text('profile_name')} AND {_truthy_text('client_name')}
    AND id IN (SELECT id FROM profiles WHERE is_active = true)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY seq DESC) = 1
)
SELECT p.id, p.account_id,
  CASE WHEN w.id IS NULL THEN p.profile_name ELSE w.profile_name END AS profile_name,
  CASE WHEN w.id IS NULL THEN p.client_name ELSE w.client_name END AS client_name,
  CASE WHEN w.id IS NULL THEN p.client_whatsapp ELSE {_text_or('w.client_whatsapp', '')} END AS client_whatsapp,
  CASE WHEN w.id IS NULL THEN p.sale_price ELSE {_num_or('w.sale_price', 0, 'DECIMAL(10,2)')} END AS sale_price,
  CASE WHEN w.id IS NULL THEN p.expiry_date ELSE w.expiry_date END AS expiry_date,
  p.is_active, p.created_at
FROM profiles p LEFT JOIN win w ON w.id = p.id
"""


def merge_profiles_sql(req: str) -> str:
    fields = ["profile_name", "client_name", "client_whatsapp", "sale_price", "expiry_date"]
    aggs = ", ".join(f"arg_max({f}, seq) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in fields)
    cols = ", ".join(f"COALESCE(w.{f}, p.{f}) AS {f}" for f in fields)
    return f""", req AS ({req}),
win AS (SELECT id, {aggs} FROM req WHERE id IN (SELECT id FROM profiles) GROUP BY id)
SELECT p.id, p.account_id, {cols}, p.is_active, p.created_at
FROM profiles p LEFT JOIN win w ON w.id = p.id
"""


def soft_delete_sql(req: str) -> str:
    return f""", req AS ({req})
SELECT id, account_id, profile_name, client_name, client_whatsapp, sale_price, expiry_date,
       CASE WHEN is_active = true AND id IN (SELECT id FROM req) THEN false ELSE is_active END AS is_active,
       created_at
FROM profiles
"""


def delete_accounts_sql(req: str) -> str:
    return f""", req AS ({req})
SELECT * FROM profiles WHERE account_id NOT IN (SELECT id FROM req)
"""


def delete_platforms_sql(req: str) -> str:
    return f""", req AS ({req})
SELECT * FROM profiles
WHERE account_id NOT IN (SELECT a.id FROM accounts a WHERE a.platform_id IN (SELECT id FROM req))
"""


RESET_SUMMARY = """
SELECT (SELECT COUNT(*) FROM platforms) AS total_platforms, CAST(0 AS BIGINT) AS total_accounts,
       CAST(0 AS BIGINT) AS total_profiles, CAST(0 AS BIGINT) AS active_clients,
       CAST(0 AS DECIMAL(38,2)) AS total_costs, CAST(0 AS DECIMAL(38,2)) AS total_revenue,
       CAST(0 AS BIGINT) AS expired_profiles, CAST(0 AS BIGINT) AS expiring_soon_profiles,
       CAST(0 AS BIGINT) AS expired_accounts, CAST(0 AS BIGINT) AS expiring_soon_accounts,
       CAST(0 AS DECIMAL(38,2)) AS total_profit, CAST(0 AS BIGINT) AS expiring_soon_total,
       true AS profit_non_negative
"""

RESET_REPORT = """
SELECT 'platforms' AS table_name, (SELECT COUNT(*) FROM platforms) AS rows_before,
       (SELECT COUNT(*) FROM platforms) AS rows_after
UNION ALL SELECT 'accounts', (SELECT COUNT(*) FROM accounts), CAST(0 AS BIGINT)
UNION ALL SELECT 'profiles', (SELECT COUNT(*) FROM profiles), CAST(0 AS BIGINT)
UNION ALL SELECT 'renewals', (SELECT COUNT(*) FROM renewals), CAST(0 AS BIGINT)
"""

_LOG_COLS = (
    "seq, profile_id, account_id, account_email, platform_id, platform_name, platform_icon, platform_color, "
    "profile_name, client_name, client_whatsapp"
)


def renew_profiles_ctes(req: str) -> str:
    return f""", req AS ({req}),
live AS ({_LIVE} WHERE p.is_active = true),
ok AS (
  SELECT r.seq, r.profile_id, r.new_expiry_date, r.sale_price AS price, l.account_id, l.account_email,
         l.platform_id, l.platform_name, l.platform_icon, l.platform_color, l.profile_name, l.client_name,
         l.client_whatsapp, l.expiry_date AS current_expiry
  FROM req r JOIN live l ON l.id = r.profile_id
  WHERE r.new_expiry_date IS NOT NULL
),
log AS (
  SELECT {_LOG_COLS},
    COALESCE(LAG(new_expiry_date) OVER (PARTITION BY profile_id ORDER BY seq), current_expiry) AS old_expiry_date,
    new_expiry_date, CAST(COALESCE(price, 0) AS DECIMAL(10,2)) AS sale_price, 'profile' AS renewal_type,
    {{now}} AS created_at
  FROM ok
)
"""


def renew_profiles_sql(req: str, now: str) -> str:
    return renew_profiles_ctes(req).replace("{now}", now) + "SELECT * FROM log"


def renew_accounts_sql(req: str, now: str) -> str:
    return f""", req AS ({req}),
ok AS (
  SELECT r.seq, r.account_id, r.new_expiry_date, r.renewal_cost AS price, a.email AS account_email,
         pl.id AS platform_id, pl.name AS platform_name, pl.icon AS platform_icon, pl.color AS platform_color,
         a.expiry_date AS current_expiry
  FROM req r JOIN accounts a ON a.id = r.account_id JOIN platforms pl ON pl.id = a.platform_id
  WHERE r.new_expiry_date IS NOT NULL
)
SELECT seq, CAST(NULL AS BIGINT) AS profile_id, account_id, account_email, platform_id, platform_name,
       platform_icon, platform_color, '' AS profile_name, '' AS client_name, '' AS client_whatsapp,
       COALESCE(LAG(new_expiry_date) OVER (PARTITION BY account_id ORDER BY seq), current_expiry) AS old_expiry_date,
       new_expiry_date, CAST(COALESCE(price, 0) AS DECIMAL(10,2)) AS sale_price, 'account' AS renewal_type,
       {now} AS created_at
FROM ok
"""


def renewal_outbox_sql(req: str, now: str) -> str:
    msg = renewal_msg("l.platform_name", "l.account_email", "l.profile_name", "g.new_expiry_date")
    return (
        renew_profiles_ctes(req).replace("{now}", now)
        + f"""
SELECT seq, profile_id, client_whatsapp, message, {link('client_whatsapp', 'message')} AS link
FROM (
  SELECT g.seq, g.profile_id, l.client_whatsapp, {msg} AS message
  FROM log g JOIN ({_LIVE}) l ON l.id = g.profile_id
  WHERE l.client_whatsapp <> ''
)
"""
    )


def renewal_target_sql(req: str, as_of: str) -> str:
    return f""", req AS ({req})
SELECT r.seq, r.id, CAST(r.days AS INTEGER) AS days,
  CASE WHEN r.days IS NULL OR r.days <= 0 OR p.id IS NULL THEN NULL
       ELSE greatest(COALESCE(p.expiry_date, {as_of}), {as_of}) + CAST(r.days AS INTEGER) END AS new_expiry_date,
  CASE WHEN r.days IS NULL OR r.days <= 0 THEN 'invalid_days' WHEN p.id IS NULL THEN 'not_found' END AS reason
FROM req r LEFT JOIN (SELECT * FROM profiles WHERE is_active = true) p ON p.id = r.id
"""


def seed_defaults_sql(as_of: str, empty: bool = False) -> str:
    """The platforms, or the defaults where there are none (``empty``: as if there were none)."""
    defaults = f"""
SELECT CAST(id AS INTEGER) AS id, name, icon, color, CAST(max_profiles AS INTEGER) AS max_profiles, {as_of} AS created_on
FROM (VALUES {DEFAULT_PLATFORMS}) AS d(id, name, icon, color, max_profiles)"""
    return defaults if empty else f"SELECT * FROM platforms UNION ALL {defaults} WHERE NOT EXISTS (FROM platforms)"


CONFORM_SCHEMA = """
SELECT profile_id, CAST(NULL AS BIGINT) AS account_id, CAST(NULL AS INTEGER) AS platform_id,
       '' AS account_email, '' AS platform_name, '' AS profile_name, '' AS client_name, '' AS client_whatsapp,
       '' AS platform_icon, '' AS platform_color, CAST(NULL AS DATE) AS old_expiry_date, new_expiry_date,
       sale_price, 'profile' AS renewal_type, created_at
FROM renewals
"""

CONFORM_PROFILES = """
SELECT id, account_id, profile_name, client_name, CAST(NULL AS VARCHAR) AS client_whatsapp, sale_price, expiry_date,
       true AS is_active, created_at
FROM profiles
"""

# ------------------------------------------ rejections and other tables of a change
_NEEDED = {
    ("insert", "accounts"): [_truthy_num("platform_id"), _truthy_text("email"), _truthy_text("password")],
    ("insert", "profiles"): [_truthy_num("account_id"), _truthy_text("profile_name"), _truthy_text("client_name")],
    ("update", "accounts"): [_truthy_text("email"), _truthy_text("password")],
    ("update", "profiles"): [_truthy_text("profile_name"), _truthy_text("client_name")],
}
_PARENT = {"accounts": ("platform_id", "platforms"), "profiles": ("account_id", "accounts")}


def _reasons(req: str, cases: str) -> str:
    return f", req AS ({req}) SELECT * FROM (SELECT seq, CASE {cases} END AS reason FROM req) WHERE reason IS NOT NULL"


def rejected_insert_sql(req: str, table: str) -> str:
    key, parent = _PARENT[table]
    valid = " AND ".join(_NEEDED["insert", table])
    return _reasons(
        req, f"WHEN NOT ({valid}) THEN 'missing_field' WHEN NOT EXISTS (FROM {parent} AS up WHERE up.id = req.{key}) THEN 'parent_not_found'"
    )


def rejected_update_sql(req: str, table: str) -> str:
    valid, live = " AND ".join(_NEEDED["update", table]), "AND is_active" if table == "profiles" else ""
    return _reasons(
        req, f"WHEN NOT ({valid}) THEN 'missing_field' WHEN NOT EXISTS (FROM {table} AS x WHERE x.id = req.id {live}) THEN 'not_found'"
    )


def rejected_delete_sql(req: str, table: str) -> str:
    """Only the first request on an existing id is carried out."""
    again = "seq > (SELECT min(seq) FROM req AS first WHERE first.id = req.id)"
    return _reasons(req, f"WHEN {again} OR NOT EXISTS (FROM {table} AS x WHERE x.id = req.id) THEN 'not_found'")


def rejected_renewal_sql(req: str, key: str) -> str:
    live = {
        "profile_id": "FROM profiles AS x, accounts AS a, platforms AS p WHERE x.id = req.profile_id AND x.is_active AND a.id = x.account_id AND p.id = a.platform_id",
        "account_id": "FROM accounts AS a, platforms AS p WHERE a.id = req.account_id AND p.id = a.platform_id",
    }[key]
    return _reasons(req, f"WHEN new_expiry_date IS NULL THEN 'missing_field' WHEN NOT EXISTS ({live}) THEN 'not_found'")


def renewed_table_sql(req: str, table: str) -> str:
    """The table with the last requested date of every row that can be renewed."""
    key, live = {"profiles": ("profile_id", "is_active"), "accounts": ("account_id", "true")}[table]
    last = f"SELECT arg_max(new_expiry_date, seq) FROM req WHERE req.{key} = x.id AND new_expiry_date IS NOT NULL"
    return f", req AS ({req}) SELECT x.* REPLACE (ifnull(CASE WHEN {live} THEN ({last}) END, expiry_date) AS expiry_date) FROM {table} AS x"


def delete_platforms_accounts_sql(req: str) -> str:
    return f", req AS ({req}) SELECT * FROM accounts AS a WHERE NOT EXISTS (FROM req WHERE req.id = a.platform_id)"


def _or_text(c: str, text: str) -> str:
    return f"ifnull(nullif({c}, ''), '{text}')"


PROFILE_DISPLAY = f"""
SELECT id, {_or_text('client_name', 'Sin asignar')} AS client_text, {_or_text('client_whatsapp', 'No registrado')} AS phone_text,
       CASE WHEN sale_price > 0 THEN {money_txt('sale_price')} ELSE 'No definido' END AS price_text,
       {long_date('expiry_date')} AS expiry_text
FROM ({profile_list_sql('')})
"""


def expiring_display_sql(days: int) -> str:
    return f"""
SELECT type, id, platform_icon || ' ' || platform_name AS platform_text,
       CASE type WHEN 'account' THEN {_or_text('provider_name', '—')} ELSE {_or_text('client_name', '—')} END AS who_text,
       {money_txt("ifnull(cost, sale_price)")} AS amount_text, {long_date('expiry_date')} AS expiry_text
FROM ({expiring_within_sql(days)})
"""


def creation_outbox_sql(req: str, now: str) -> str:
    """A notice for each inserted profile with a phone."""
    msg = renewal_msg("brand.name", "holder.email", "fresh.profile_name", "fresh.expiry_date")
    made = insert_profiles_sql(req, now)
    cte = f", req AS ({req}), fresh AS ({made[made.index(req) + len(req) + 1:]})"
    return f"""{cte}
SELECT profile_id, account_id, client_whatsapp, message, {link('client_whatsapp', 'message')} AS link
FROM (SELECT fresh.id AS profile_id, fresh.account_id, fresh.client_whatsapp, {msg} AS message
      FROM fresh, accounts AS holder, platforms AS brand
      WHERE holder.id = fresh.account_id AND brand.id = holder.platform_id AND fresh.client_whatsapp <> '')
"""


# ------------------------------------------------- requests of every kind in one batch
def _replay_ctes(req: str, as_of: str) -> str:
    """``told``: every request with its id, its account and platform, and its reason."""

    def life(table: str, one: str, parent: str = "", key: str = "") -> str:
        own = f", {key}" if key else ""
        new = f", CAST(parent_id AS BIGINT) AS {key}" if key else ""
        old = f", CAST({key} AS BIGINT) AS {key}" if key else ""
        here = "" if not parent else f" AND EXISTS (SELECT 1 FROM {parent}_life u WHERE u.id = parent_id AND u.born < seq AND seq < u.died)"
        end = "99999999999999999" if not parent else f"COALESCE((SELECT max(u.died) FROM {parent}_life u WHERE u.id = l.{key}), 99999999999999999)"
        deletes = f"(SELECT min(d.seq) FROM asked d WHERE d.kind = 'delete_{one}' AND d.wrong IS NULL AND d.id = l.id AND d.seq > l.born)"
        first = f"CAST(COALESCE({deletes}, 99999999999999999) AS BIGINT)"
        active = " WHERE is_active" if one == "profile" else ""
        return f"""
{one}_born AS (
  SELECT CAST(id AS BIGINT) AS id{old}, CAST(-1 AS BIGINT) AS born FROM {table}{active}
  UNION ALL SELECT id{new}, seq FROM asked WHERE kind = 'insert_{one}' AND wrong IS NULL{here}),
{one}_life AS (SELECT id{own}, born, {first} AS off, least({first}, CAST({end} AS BIGINT)) AS died FROM {one}_born l)"""

    return f""", req AS ({req}),
asked AS (
  SELECT * REPLACE (CAST(CASE kind
           WHEN 'insert_platform' THEN (SELECT max(id) FROM platforms) + seq - (SELECT min(seq) FROM req) + 1
           WHEN 'insert_account' THEN (SELECT max(id) FROM accounts) + seq - (SELECT min(seq) FROM req) + 1
           WHEN 'insert_profile' THEN (SELECT max(id) FROM profiles) + seq - (SELECT min(seq) FROM req) + 1
           ELSE id END AS BIGINT) AS id),
         CASE WHEN kind IN ('insert_platform', 'update_platform') AND NOT {_truthy_text('name')} THEN 'missing_field'
              WHEN kind IN ('insert_account', 'update_account') AND NOT ({_truthy_text('email')} AND {_truthy_text('password')}) THEN 'missing_field'
              WHEN kind IN ('insert_profile', 'update_profile') AND NOT ({_truthy_text('name')} AND {_truthy_text('client_name')}) THEN 'missing_field'
              WHEN kind IN ('insert_account', 'insert_profile') AND NOT {_truthy_num('parent_id')} THEN 'missing_field'
              WHEN kind LIKE 'renew%' AND expiry_date IS NULL AND days IS NULL THEN 'missing_field'
              WHEN kind LIKE 'renew%' AND expiry_date IS NULL AND days <= 0 THEN 'invalid_days' END AS wrong
  FROM req),{life('platforms', 'platform')},{life('accounts', 'account', 'platform', 'platform_id')},{life('profiles', 'profile', 'account', 'account_id')},
met AS (
  SELECT q.*, split_part(q.kind, '_', 1) AS verb, split_part(q.kind, '_', 2) AS what,
         COALESCE(x.born, y.born, z.born) AS born, COALESCE(x.died, y.died, z.died) AS died, COALESCE(x.off, y.off, z.off) AS off,
         CASE split_part(q.kind, '_', 2) WHEN 'account' THEN y.id WHEN 'profile' THEN z.account_id END AS account_id,
         CASE split_part(q.kind, '_', 2) WHEN 'account' THEN y.platform_id WHEN 'profile' THEN w.platform_id END AS platform_id
  FROM asked q
  LEFT JOIN platform_life x ON q.kind LIKE '%platform' AND x.id = q.id
  LEFT JOIN account_life y ON q.kind LIKE '%account' AND y.id = q.id
  LEFT JOIN profile_life z ON q.kind LIKE '%profile' AND z.id = q.id
  LEFT JOIN account_life w ON w.id = z.account_id),
told AS (
  SELECT *, CASE WHEN wrong IS NOT NULL THEN wrong
      WHEN verb = 'insert' THEN CASE WHEN born IS NULL THEN 'parent_not_found' END
      WHEN born IS NULL OR seq <= born THEN 'not_found'
      WHEN verb = 'delete' THEN CASE WHEN seq <> off OR seq > died THEN 'not_found' END
      WHEN seq >= died THEN 'not_found'
      WHEN verb = 'renew' AND platform_id NOT IN (SELECT id FROM platform_born) THEN 'not_found' END AS reason
  FROM met),
event AS (
  SELECT seq, kind, what, id, NOT (kind = 'renew_profile' AND expiry_date IS NULL) AS sets, days,
         CASE WHEN kind = 'renew_account' THEN COALESCE(expiry_date, {as_of} + days) ELSE expiry_date END AS d,
         row_number() OVER (PARTITION BY what, id ORDER BY seq) AS pos
  FROM told WHERE reason IS NULL AND what <> 'platform' AND verb <> 'delete'),
base AS (SELECT 'account' AS what, id, expiry_date FROM accounts UNION ALL SELECT 'profile', id, expiry_date FROM profiles),
dated AS (
  SELECT * FROM (
    WITH RECURSIVE chain AS (
      SELECT e.*, b.expiry_date AS old_date,
             CASE WHEN e.sets THEN e.d ELSE greatest(COALESCE(b.expiry_date, {as_of}), {as_of}) + e.days END AS new_date
      FROM event e LEFT JOIN base b ON b.what = e.what AND b.id = e.id WHERE e.pos = 1
      UNION ALL
      SELECT e.*, c.new_date, CASE WHEN e.sets THEN e.d ELSE greatest(COALESCE(c.new_date, {as_of}), {as_of}) + e.days END
      FROM chain c JOIN event e ON e.what = c.what AND e.id = c.id AND e.pos = c.pos + 1)
    SELECT * FROM chain))
"""


def replay_outcomes_sql(req: str, as_of: str) -> str:
    return _replay_ctes(req, as_of) + "SELECT seq, kind, id, reason FROM told"


def replay_log_sql(req: str, as_of: str, now: str) -> str:
    """Labels by ASOF joins with the edits of each profile, account and platform."""
    edits = lambda name, what, values, first, table: f"""
{name} AS (
  SELECT id, seq, {values} FROM told WHERE reason IS NULL AND what = '{what}' AND verb IN ('insert', 'update')
  UNION ALL SELECT CAST(id AS BIGINT), CAST(-1 AS BIGINT), {first} FROM {table})"""  # noqa: E731
    return (
        _replay_ctes(req, as_of)
        + f""",{edits('names', 'profile', "name AS profile_name, client_name, COALESCE(client_whatsapp, '') AS client_whatsapp", 'profile_name, client_name, client_whatsapp', 'profiles')},
{edits('emails', 'account', 'email', 'email', 'accounts')},
{edits('brands', 'platform', f"name, {_text_or('icon', '📺')} AS icon, {_text_or('color', '#6c5ce7')} AS color", 'name, icon, color', 'platforms')},
renewed AS (SELECT * FROM told WHERE reason IS NULL AND verb = 'renew')
SELECT CASE WHEN r.what = 'profile' THEN r.id END AS profile_id, r.account_id, CAST(r.platform_id AS INTEGER) AS platform_id, e.email AS account_email,
       b.name AS platform_name, CASE WHEN r.what = 'profile' THEN n.profile_name ELSE '' END AS profile_name,
       CASE WHEN r.what = 'profile' THEN n.client_name ELSE '' END AS client_name,
       CASE WHEN r.what = 'profile' THEN n.client_whatsapp ELSE '' END AS client_whatsapp, b.icon AS platform_icon, b.color AS platform_color,
       d.old_date AS old_expiry_date, d.new_date AS new_expiry_date, CAST(COALESCE(r.price, 0) AS DECIMAL(10,2)) AS sale_price,
       r.what AS renewal_type, {now} AS created_at
FROM renewed r ASOF LEFT JOIN names n ON r.id = n.id AND r.seq > n.seq
ASOF LEFT JOIN emails e ON r.account_id = e.id AND r.seq > e.seq
ASOF LEFT JOIN brands b ON r.platform_id = b.id AND r.seq > b.seq
JOIN dated d ON d.seq = r.seq
"""
    )


def replay_table_sql(req: str, as_of: str, now: str, table: str, whole: bool = True) -> str:
    """A table after the batch: the last counted edit of each row that is still there
    (not ``whole``: as one more common table, new_platforms and so on)."""
    mark = "" if whole else "new_"
    one = table[:-1]
    number = lambda c, default, kind: _num_or(c, default, kind)
    fields = {
        "platforms": (f"name, {_text_or('icon', '📺')} AS icon, {_text_or('color', '#6c5ce7')} AS color, {number('max_profiles', 5, 'INTEGER')} AS max_profiles", "name, icon, color, max_profiles"),
        "accounts": (f"email, COALESCE(provider_name, '') AS provider_name, {number('cost', 0, 'DECIMAL(10,2)')} AS cost", "email, provider_name, cost"),
        "profiles": (f"name AS profile_name, client_name, COALESCE(client_whatsapp, '') AS client_whatsapp, {number('price', 0, 'DECIMAL(10,2)')} AS sale_price", "profile_name, client_name, client_whatsapp, sale_price"),
    }[table]
    kind = "INTEGER" if table == "platforms" else "BIGINT"
    parent = {"platforms": "", "accounts": ", CAST(v.platform_id AS INTEGER) AS platform_id", "profiles": ", v.account_id"}[table]
    born = f"COALESCE(t.created_at, {now}) AS created_at" if table == "profiles" else f"COALESCE(t.created_on, {as_of}) AS created_on"
    date = "" if table == "platforms" else ", CASE WHEN m.id IS NULL THEN t.expiry_date ELSE m.new_date END AS expiry_date"
    moved = "" if table == "platforms" else f"LEFT JOIN (SELECT id, arg_max(struct_pack(d := new_date), seq).d AS new_date FROM dated WHERE what = '{one}' GROUP BY id) m ON m.id = v.id"
    active = ", v.on_since AS is_active" if table == "profiles" else ""
    rows = f"SELECT *, died = 99999999999999999 AS stays FROM {one}_life"
    if table == "profiles":  # a released or inactive row stays as long as its account
        rows = """SELECT l.id, l.account_id, l.off = 99999999999999999 AS on_since,
                 COALESCE((SELECT max(u.died) FROM account_life u WHERE u.id = l.account_id), 99999999999999999) = 99999999999999999 AS stays
          FROM (SELECT id, account_id, off FROM profile_life UNION ALL SELECT id, account_id, CAST(0 AS BIGINT) FROM profiles WHERE NOT is_active) l"""
    return (
        (_replay_ctes(req, as_of) + ", " if whole else "")
        + f"""{mark and f'{mark}{table}_'}edit AS (
  SELECT id, seq, {fields[0]} FROM told WHERE reason IS NULL AND what = '{one}' AND verb IN ('insert', 'update')
  UNION ALL SELECT CAST(id AS BIGINT), CAST(-1 AS BIGINT), {fields[1]} FROM {table}),
{mark and f'{mark}{table}_'}last AS (SELECT * FROM {mark and f'{mark}{table}_'}edit QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
{"" if whole else f", {mark}{table} AS ("}SELECT CAST(v.id AS {kind}) AS id{parent}, {", ".join("e." + c for c in fields[1].split(", "))}{date}{active}, {born}
FROM ({rows}) v JOIN {mark and f'{mark}{table}_'}last e ON e.id = v.id LEFT JOIN {table} t ON t.id = v.id {moved}
WHERE v.stays{"" if whole else ")"}
"""
    )


def admission_sql(req: str) -> str:
    """Requests of each account folded one by one over its list."""
    return f""", req AS ({req}),
asked AS (
  SELECT * REPLACE (CAST(CASE kind WHEN 'insert_profile' THEN (SELECT max(id) FROM profiles) + seq - (SELECT min(seq) FROM req) + 1 ELSE id END AS BIGINT) AS id),
         kind = 'insert_profile' AND NOT ({_profile_insert_valid()}) AS bad
  FROM req),
target AS (
  SELECT id, account_id, CAST(-1 AS BIGINT) AS born FROM profiles WHERE is_active
  UNION ALL SELECT id, account_id, seq FROM asked WHERE kind = 'insert_profile' AND NOT bad),
event AS (
  SELECT seq, id, account_id, true AS enters, false AS made FROM asked WHERE kind = 'insert_profile' AND NOT bad
  UNION ALL
  SELECT min(q.seq), q.id, any_value(x.account_id), false, any_value(x.born) >= 0 FROM asked q JOIN target x ON x.id = q.id AND q.seq > x.born
  WHERE q.kind = 'delete_profile' GROUP BY q.id),
folded AS (
  SELECT list_reduce(
      list_prepend(struct_pack(seq := CAST(0 AS BIGINT), id := CAST(0 AS BIGINT), enters := false, made := false, n := any_value(s.n), cap := any_value(s.cap), ins := CAST([] AS BIGINT[]), ok := CAST([] AS BIGINT[])),
        list(struct_pack(seq := e.seq, id := e.id, enters := e.enters, made := e.made, n := CAST(0 AS BIGINT), cap := s.cap, ins := CAST([] AS BIGINT[]), ok := CAST([] AS BIGINT[])) ORDER BY e.seq)),
      lambda a, x: struct_pack(seq := x.seq, id := x.id, enters := x.enters, made := x.made,
        n := CASE WHEN x.enters AND a.n < a.cap THEN a.n + 1 WHEN NOT x.enters AND (NOT x.made OR list_contains(a.ins, x.id)) THEN a.n - 1 ELSE a.n END,
        cap := a.cap, ins := CASE WHEN x.enters AND a.n < a.cap THEN list_append(a.ins, x.id) ELSE a.ins END,
        ok := CASE WHEN (x.enters AND a.n < a.cap) OR (NOT x.enters AND (NOT x.made OR list_contains(a.ins, x.id))) THEN list_append(a.ok, x.seq) ELSE a.ok END)).ok AS ok
  FROM event e JOIN (
    SELECT a.id AS account_id, CAST(pl.max_profiles AS BIGINT) AS cap, (SELECT count(*) FROM profiles p WHERE p.account_id = a.id AND p.is_active) AS n
    FROM accounts a JOIN platforms pl ON pl.id = a.platform_id) s ON s.account_id = e.account_id
  GROUP BY e.account_id),
counted AS (SELECT unnest(ok) AS seq FROM folded)
SELECT q.seq, q.kind, q.id,
       CASE WHEN q.seq IN (SELECT seq FROM counted) THEN NULL
            WHEN q.kind = 'delete_profile' THEN 'not_found'
            WHEN NOT ({_truthy_num('q.account_id')} AND {_truthy_text('q.profile_name')} AND {_truthy_text('q.client_name')}) THEN 'missing_field'
            WHEN q.bad THEN 'parent_not_found' ELSE 'account_full' END AS reason
FROM asked q
"""


# ------------------------------------------------- a range of reporting dates
def _dates(first: str, last: str) -> str:
    return f"(SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS as_of)"


def platform_expiry_series_sql(first: str, last: str) -> str:
    """R2 asked again for every date."""
    due = "coalesce(expiry_date BETWEEN as_of + 1 AND as_of + 7, false)"
    return f"""
SELECT CAST(day.as_of AS DATE) AS as_of, p.id,
       CAST(ifnull(held.late, 0) AS BIGINT) AS expired_accounts, CAST(ifnull(held.due, 0) AS BIGINT) AS expiring_soon_accounts,
       CAST(ifnull(sold.late, 0) AS BIGINT) AS expired_profiles, CAST(ifnull(sold.due, 0) AS BIGINT) AS expiring_soon_profiles
FROM {_dates(first, last)} AS day CROSS JOIN platforms p
LEFT JOIN (
  SELECT as_of, platform_id, sum(greatest(ifnull(n, 0), 1)) FILTER (expiry_date <= as_of) AS late, sum(greatest(ifnull(n, 0), 1)) FILTER ({due}) AS due
  FROM {_dates(first, last)} AS d CROSS JOIN accounts a LEFT JOIN (SELECT account_id, count(*) AS n FROM profiles GROUP BY ALL) AS c ON c.account_id = a.id
  GROUP BY ALL) AS held ON held.as_of = day.as_of AND held.platform_id = p.id
LEFT JOIN (
  SELECT as_of, a.platform_id, count(*) FILTER (x.expiry_date <= as_of) AS late, count(*) FILTER ({due.replace('expiry_date', 'x.expiry_date')}) AS due
  FROM {_dates(first, last)} AS d CROSS JOIN profiles x JOIN accounts a ON a.id = x.account_id GROUP BY ALL) AS sold
  ON sold.as_of = day.as_of AND sold.platform_id = p.id
"""


def expiry_totals_series_sql(first: str, last: str, days: int) -> str:
    def counts(name: str) -> str:
        soon = "count(*) FILTER (expiry_date BETWEEN as_of + 1 AND as_of + 7)"
        return f"count(*) FILTER (expiry_date <= as_of) AS expired_{name}, {soon} AS expiring_soon_{name}, count(*) FILTER (expiry_date <= as_of + {days}) AS due_{name}"

    return f"""
SELECT * FROM (SELECT as_of, {counts('accounts')} FROM {_dates(first, last)} AS d CROSS JOIN accounts GROUP BY as_of)
JOIN (SELECT as_of, {counts('profiles')} FROM {_dates(first, last)} AS d CROSS JOIN profiles WHERE is_active GROUP BY as_of) USING (as_of)
"""


def platform_report_after_sql(req: str, as_of: str, now: str) -> str:
    """R9 asked of the tables that the batch leaves."""
    tables = ", ".join(replay_table_sql(req, as_of, now, name, whole=False) for name in ("platforms", "accounts", "profiles"))
    log = replay_log_sql(req, as_of, now)
    log = log[log.index(",", log.index("SELECT * FROM chain))")) :]  # the labels, without the common tables above
    head, rows = log.rsplit("\nSELECT CASE", 1)
    report = PLATFORM_REPORT
    for name in ("platforms", "accounts", "profiles", "renewals"):
        report = re.sub(rf"\b{name}\b", f"new_{name}", report)
    return f"""{_replay_ctes(req, as_of)}, {tables}{head},
new_renewals AS (SELECT platform_id, renewal_type, sale_price FROM renewals UNION ALL SELECT platform_id, renewal_type, sale_price FROM (SELECT CASE{rows}))
{report}"""


# ------------------------------------------------- distinct counts over the log
_RENEWED = """
  count(DISTINCT account_id) AS accounts, count(DISTINCT profile_id) AS profiles,
  count(DISTINCT account_id) FILTER (WHERE renewal_type = 'account') AS accounts_paid"""

RENEWED_MONTHLY = f"""
SELECT {_MONTH} AS month, {_RENEWED}
FROM renewals GROUP BY ALL
"""


def renewed_platforms_sql(first: str, last: str) -> str:
    return f"""
SELECT platform_id, {_RENEWED}, grouping(platform_id) = 1 AS is_total
FROM renewals WHERE {_MONTH} BETWEEN '{first}' AND '{last}'
GROUP BY GROUPING SETS ((platform_id), ())
"""
