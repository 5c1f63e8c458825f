"""Display and message text as built-in Column expressions (no Python UDF).

These re-create, set-wise, what the original computed per row in the browser:
money and date text in Spanish style, expiry badges, occupancy, customer
messages and their chat links.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month names, in calendar order.
MONTHS_ES = [
    "enero",
    "febrero",
    "marzo",
    "abril",
    "mayo",
    "junio",
    "julio",
    "agosto",
    "septiembre",
    "octubre",
    "noviembre",
    "diciembre",
]
# Texts shown for missing values.
NO_DATE = "Sin fecha"
NO_PIN = "Sin PIN"
# The password is never carried; the renewal message shows this instead.
PASSWORD_PLACEHOLDER = "********"
CHAT_LINK_PREFIX = "https://wa.me/"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _d(as_of: dt.date | str) -> Column:
    return F.lit(dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of)


# ---------------------------------------------------------------- numbers
def money_text(c: Column | str) -> Column:
    """'$' + amount with two decimals, Spanish style.

    ',' is the decimal mark and '.' groups thousands, but only from five
    integer digits on (CLDR minimum grouping digits of 'es'): 1234,50 and
    12.345,67. Null and non-numbers show as 0,00.
    """
    x = F.coalesce(_c(c).cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)"))
    plain = F.translate(F.call_function("format_number", x, F.lit("0.00")), ".", ",")
    grouped = F.translate(F.format_number(x, 2), ",.", ".,")
    return F.concat(F.lit("$"), F.when(F.abs(x) < 10000, plain).otherwise(grouped))


def occupancy_pct(count: Column | str, max_profiles: Column | str) -> Column:
    """share of seats used, in percent, capped at 100 (without seats: 100 once any is used, else null)."""
    share = F.try_divide(_c(count), _c(max_profiles)) * F.lit(100.0)
    return F.when((_c(max_profiles) == 0) & (_c(count) > 0), F.lit(100.0)).otherwise(F.least(F.lit(100.0), share))


def is_full(count: Column | str, max_profiles: Column | str) -> Column:
    """an account is full when its active profiles reach max_profiles."""
    return _c(count) >= _c(max_profiles)


# ------------------------------------------------------------------ dates
def date_prefix(text: Column | str) -> Column:
    """F8 for text input: the leading yyyy-MM-dd, null when absent or invalid."""
    return F.try_to_date(F.regexp_extract(_c(text).cast("string"), r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")


def days_until(date: Column | str, as_of: dt.date | str) -> Column:
    """F8: whole days from today to the date (negative when past, null when missing)."""
    return F.datediff(_c(date), _d(as_of)).cast("bigint")


def long_date_text(date: Column | str) -> Column:
    """'05 de enero de 2000'; 'Sin fecha' when missing."""
    d = _c(date)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS_ES]), F.month(d))
    text = F.concat(
        F.lpad(F.dayofmonth(d).cast("string"), 2, "0"),
        F.lit(" de "),
        month,
        F.lit(" de "),
        F.year(d).cast("string"),
    )
    return F.when(d.isNull(), F.lit(NO_DATE)).otherwise(text)


def day_count_text(days: Column | str) -> Column:
    """F16: '1 día' or 'n días'."""
    n = _c(days)
    return F.when(n == 1, F.lit("1 día")).otherwise(F.concat(n.cast("string"), F.lit(" días")))


# Expiry badge classes, icons and texts.
BADGE_NO_DATE = ("no-date", "📅")
BADGE_OVERDUE = ("expired", "🔴")
BADGE_TODAY = ("expired", "⚠️")
BADGE_WARNING = ("warning", "🟡")
BADGE_ACTIVE = ("active", "🟢")
WARNING_DAYS = 3


def expiry_badge(date: Column | str, as_of: dt.date | str) -> dict[str, Column]:
    """class, icon and text of the expiry badge.

    Overdue (< 0), due today (0, class 'expired'), warning (1-3 days), later
    'active'; no date gives 'Sin fecha'.
    """
    n = days_until(date, as_of)
    s = n.cast("string")

    def pick(i: int) -> Column:
        return (
            F.when(n.isNull(), F.lit(BADGE_NO_DATE[i]))
            .when(n < 0, F.lit(BADGE_OVERDUE[i]))
            .when(n == 0, F.lit(BADGE_TODAY[i]))
            .when(n <= WARNING_DAYS, F.lit(BADGE_WARNING[i]))
            .otherwise(F.lit(BADGE_ACTIVE[i]))
        )

    text = (
        F.when(n.isNull(), F.lit(NO_DATE))
        .when(n < 0, F.concat(F.lit("Venció hace "), F.abs(n).cast("string"), F.lit(" día(s)")))
        .when(n == 0, F.lit("Vence hoy"))
        .when(n <= WARNING_DAYS, F.concat(F.lit("Vence en "), s, F.lit(" día(s)")))
        .otherwise(F.concat(F.lit("Vence en "), s, F.lit(" días")))
    )
    return {"days_left": n, "status_class": pick(0), "status_icon": pick(1), "status_text": text}


# --------------------------------------------------------------- messages
def phone_digits(c: Column | str) -> Column:
    """digits only."""
    return F.regexp_replace(_c(c), r"[^0-9]", "")


def uri_component(c: Column | str) -> Column:
    """percent-encoding of a URI component (UTF-8).

    Spark's form encoding differs from a URI component in six places: space
    is '+', and ! ' ( ) ~ are escaped; they are mapped back here. '*' is kept
    by both.
    """
    e = F.url_encode(_c(c))
    for enc, raw in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(enc), F.lit(raw))
    return e


def chat_link(phone: Column | str, message: Column | str) -> Column:
    """Chat link with the phone digits and the encoded message."""
    return F.concat(F.lit(CHAT_LINK_PREFIX), phone_digits(phone), F.lit("?text="), uri_component(message))


def reminder_message(client: Column | str, platform: Column | str, days: Column | str) -> Column:
    """N1 text. Fixed value: the reminder template."""
    return F.concat(
        F.lit("Hola *"),
        _c(client),
        F.lit("*\nTe recuerdo que tu cuenta de *"),
        _c(platform),
        F.lit("* vence en *"),
        day_count_text(days),
        F.lit("*. Puedes renovar cuando gustes.\n\n¡Estamos para ayudarte!"),
    )


def expiry_message(client: Column | str, platform: Column | str) -> Column:
    """N2 text (always says 'today'). Fixed value: the expiry template."""
    return F.concat(
        F.lit("Hola "),
        _c(client),
        F.lit("\nTu cuenta de *"),
        _c(platform),
        F.lit("* vence *hoy*.\nPara no perder el acceso, por favor renueva lo antes posible. \n\n¡Gracias!"),
    )


# The rules at the end of a renewal notice, and its dividing line.
RULES_BLOCK = (
    "*REGLAS:*\n"
    "1.- NO COMPARTIR LA CUENTA.\n"
    "2.- RESPETAR LOS DEMAS PERFILES.\n"
    "3.- NO CAMBIAR NADA EN LA CUENTA.\n"
    "4.- NO ACTIVAR MIEMBRO EXTRA.\n"
    "5.- USAR SOLO EN UN DISPOSITIVO.\n"
    "*¡GRACIAS POR SU PREFERENCIA! 🤗*"
)
RULE_LINE = "========================"


def renewal_message(
    platform: Column | str,
    email: Column | str,
    profile_name: Column | str,
    pin: Column | None,
    new_date: Column | str,
) -> Column:
    """N3 text. Fixed value: the renewal confirmation template.

    The original puts the account password in the text; it is replaced by a
    placeholder here. A missing PIN shows 'Sin PIN'.
    """
    pin_text = F.lit(NO_PIN) if pin is None else F.when(F.coalesce(pin, F.lit("")) == "", F.lit(NO_PIN)).otherwise(pin)
    return F.concat(
        F.lit("*🔴"),
        F.upper(_c(platform)),
        F.lit("🔴*\n" + RULE_LINE + "\n📧 *CORREO:* "),
        _c(email),
        F.lit("\n🔑 *CONTRASEÑA:* " + PASSWORD_PLACEHOLDER + "\n🖥 *PERFIL:* "),
        _c(profile_name),
        F.lit("  *PIN:* "),
        pin_text,
        F.lit("\n" + RULE_LINE + "\n📅 *VENCE: "),
        long_date_text(new_date),
        F.lit("*\n" + RULE_LINE + "\n" + RULES_BLOCK),
    )
