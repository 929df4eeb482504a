"""Dates as people write them: month names of several languages, both orders, short years, and dates told from a given day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, units, days and fillers in English, French, German, Spanish, Italian, Portuguese and Dutch.
MONTHS = (
    "january jan janvier janv januar jänner enero ene gennaio gen janeiro januari",
    "february feb février fevrier févr fevr februar febrero febbraio fevereiro fev februari",
    "march mar mars märz maerz mär mrz marzo março marco maart mrt",
    "april apr avril avr abril abr aprile",
    "may mai mayo maggio mag maio mei",
    "june jun juin juni junio giugno giu junho",
    "july jul juillet juil juli julio luglio lug julho",
    "august aug août aout agosto ago augustus",
    "september sept sep septembre septiembre setiembre settembre set setembro",
    "october oct octobre oktober okt octubre ottobre ott outubro out",
    "november nov novembre noviembre novembro",
    "december dec décembre decembre déc dezember dez diciembre dic dicembre dezembro",
)
UNITS = {
    "day": "day days jour jours tag tage tagen día dia días dias giorno giorni dag dagen",
    "week": "week weeks semaine semaines woche wochen semana semanas settimana settimane weken",
    "month": "month months mois monat monate monaten mes meses mese mesi mês maand maanden",
    "year": "year years an ans année années jahr jahre jahren año ano años anos anno anni jaar",
}
NAMED = {0: "today aujourd'hui heute hoy oggi hoje vandaag", -1: "yesterday hier gestern ayer ieri ontem gisteren", 1: "tomorrow demain morgen mañana manana domani amanhã"}
FILLERS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun lundi mardi mercredi jeudi vendredi samedi dimanche "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag lunes martes miércoles miercoles jueves viernes sábado sabado domingo of the on de del le la el den der am du di"
)
PAST, AHEAD = "il y a|vor|hace|há|ha", "in|dans|en|em|tra|fra|over"


def _word_map(groups: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for value, words in groups.items() for w in words.split() for x in (w, value)])


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def date_words(text: Column) -> Column:
    """The words of a date without its time, weekday and fillers; a month's name becomes ``m`` and its number, a unit of time its English name."""
    low = F.lower(F.trim(text))
    day = F.regexp_replace(low, r"[t\s,]+(?:at |à |um |a las )?\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:am|pm|a\.m\.|p\.m\.|uhr)?\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?\s*$", "")
    bare = F.regexp_replace(day, r"(?<=\d)(?:st|nd|rd|th|er|ère|º|ª)(?=[\s,.]|$)", "")
    words = F.filter(F.split(bare, r"[\s,/.\-]+"), lambda w: w != "")
    names = _word_map({f"m{k}": v for k, v in enumerate(MONTHS, 1)} | UNITS)
    known = F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), w))
    fillers = F.array(*[F.lit(w) for w in FILLERS.split()])
    # A filler goes only where the rest is not a date told in words.
    told = F.exists(known, lambda w: w.isin(*UNITS))
    return F.array_join(F.filter(known, lambda w: told | ~F.array_contains(fillers, w)), " ")


def _made(year: Column, month: Column, day: Column) -> Column:
    number = lambda x: F.lpad(x.cast("string"), 2, "0")
    y = year.try_cast("int")
    full = F.when(F.length(year) == 4, y).when(y < 69, 2000 + y).otherwise(1900 + y)
    return F.try_to_date(F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), number(month), number(day)), "yyyy-MM-dd")


def free_date(text: Column, today: Column | None = None, day_first: Column | bool = False) -> Column:
    """The date that a text tells, or null.

    Read are: a year first; two numbers and a year, the month before the day unless ``day_first`` or the first one is
    above 12; a month's name with a day, a year or both (the day is the first where none is given, the year that of
    ``today``); years of two digits from 1969 to 2068; eight digits; ten digits as seconds; today and the days beside it; a
    number of days, weeks, months or years ago or ahead, from ``today``.
    """
    now = F.current_date() if today is None else today
    first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    year, month, name = r"(\d{4}|\d{2})", r"(\d{1,2})", r"m(\d{1,2})"

    def read(k: Column) -> Column:
        part = lambda p, i: F.regexp_extract(k, p, i)

        def by(p: str, y: int | None, m: int, d: int | None):
            made = _made(part(p, y) if y else F.year(now).cast("string"), part(p, m), part(p, d) if d else F.lit("1"))
            return k.rlike(p), made

        numbers = rf"^{month} {month} {year}$"
        swapped = first | (part(numbers, 1).try_cast("int") > 12)
        moved = lambda n, unit: F.when(unit == "day", F.date_add(now, n)).when(unit == "week", F.date_add(now, n * 7)).when(unit == "month", F.add_months(now, n)).otherwise(F.add_months(now, n * 12))
        # "ago" is a month's name as well.
        unit = "(day|week|month|year)"
        ago, past, ahead = rf"^(\d{{1,4}}) {unit} (?:ago|m8)$", rf"^(?:{PAST}) (\d{{1,4}}) {unit}$", rf"^(?:{AHEAD}) (\d{{1,4}}) {unit}$"
        shift = lambda p, sign: (k.rlike(p), moved(part(p, 1).try_cast("int") * sign, part(p, 2)))
        cases = [
            by(rf"^(\d{{4}}) {month} {month}$", 1, 2, 3),
            (k.rlike(numbers), F.when(swapped, _made(part(numbers, 3), part(numbers, 2), part(numbers, 1))).otherwise(_made(part(numbers, 3), part(numbers, 1), part(numbers, 2)))),
            by(rf"^{month} {name} {year}$", 3, 2, 1),
            by(rf"^{name} {month} {year}$", 3, 1, 2),
            by(rf"^(\d{{4}}) {name} {month}$", 1, 2, 3),
            by(rf"^{name} (\d{{4}})$", 2, 1, None),
            by(rf"^(\d{{4}}) {name}$", 1, 2, None),
            by(rf"^{month} {name}$", None, 2, 1),
            by(rf"^{name} {month}$", None, 1, 2),
            by(r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
            (k.rlike(r"^\d{10}$"), F.to_date(F.timestamp_seconds(k.try_cast("long")))),
            *[(k.isin(*words.split()), F.date_add(now, n)) for n, words in NAMED.items()],
            shift(ago, -1), shift(past, -1), shift(ahead, 1),
        ]
        return reduce(lambda w, c: w.when(*c), cases, F)

    return let(date_words(text), read)
