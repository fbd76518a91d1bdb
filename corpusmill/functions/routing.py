"""Topic of a question, the office to turn to, and the refusal that names it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Topic and its words, tried in this order; the first match wins. (Fixed values.)
TOPIC_WORDS = (
    ("coop", r"co[-\s]?op|coop|experiential\s+learning|work\s+term|internship"),
    ("registrar", r"registrar|transcript|enrollment|enrolment|petition|appeal|grade\s+change|official\s+letter"),
    ("financial", r"financial\s+aid|osap|bursary|scholarship|award|tuition|fee|payment"),
    ("wellbeing", r"mental\s+health|counsell?ing|wellness|well[-\s]being|distress|anxiety|depression|support\s+service"),
    ("accessibility", r"accessible?\s+learning|accommodation|alc|disability|assistive"),
    ("advising", r"advis(?:or|ing|e)|registration|program\s+require|degree\s+require|course\s+select"),
)
DEFAULT_TOPIC = "advising"
#: Offices by topic, a deployment's own; these are neutral stand-ins.
CONTACTS = {topic: (f"{topic.capitalize()} office", f"https://www.example.org/{topic}/") for topic, _ in TOPIC_WORDS}
LEAD_IN = "The site has no reliable answer to this."


def topic_of(question: Column) -> Column:
    """The first topic whose words the question holds; ``DEFAULT_TOPIC`` for the rest, blank and null."""
    chosen = None
    for topic, words in TOPIC_WORDS:
        hit = F.coalesce(question.rlike(rf"(?i)\b(?:{words})\b"), F.lit(False))
        chosen = F.when(hit, topic) if chosen is None else chosen.when(hit, topic)
    return chosen.otherwise(DEFAULT_TOPIC)


def _pick(topic: Column, contacts: dict[str, tuple[str, str]], part: int) -> Column:
    named = F.create_map(*[x for t, c in contacts.items() for x in (F.lit(t), F.lit(c[part]))])
    return F.coalesce(F.try_element_at(named, topic), F.lit(contacts[DEFAULT_TOPIC][part]))


def office_of(topic: Column, contacts: dict[str, tuple[str, str]] = CONTACTS) -> Column:
    return _pick(topic, contacts, 0)


def link_of(topic: Column, contacts: dict[str, tuple[str, str]] = CONTACTS) -> Column:
    return _pick(topic, contacts, 1)


def refusal_message(topic: Column, contacts: dict[str, tuple[str, str]] = CONTACTS, lead_in: str = LEAD_IN) -> Column:
    return F.concat(F.lit(lead_in + " Please contact "), office_of(topic, contacts), F.lit(": "), link_of(topic, contacts))
