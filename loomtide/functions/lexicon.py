"""Words of tasks."""

from __future__ import annotations

# Verbs that begin a task.  Nouns that double as verbs are left out: "the build and the release notes" is one thing.
TASK_VERBS = (
    "add apply arrange ask bake borrow attend back book bring buy call cancel change charge check clean collect confirm cook create cut delete deliver deploy decorate defrost discuss do download drive draft drop "
    "email exercise feed fetch fly fill finalise finalize find finish fix follow get give go grab hire hang help install iron invite join learn leave listen make meet merge message mow move open order organise organize "
    "pack paint pay phone pick pray practice practise prepare print put read refill register remember remind renew repair replace reply reschedule research respond return say review scan schedule see sell send set share "
    "ship sign start study submit sweep take talk tell test text thank tidy transfer translate try travel update upgrade upload vacuum visit walk wash wake watch water withdraw wrap write"
).split()
# Verbs that begin a task only as its first word.
FIRST_VERBS = "sort empty ring look wish check turn let stop exchange play top answer be lock brush".split()
# What people schedule without a verb.
EVENTS = (
    "appointment birthday breakfast checkup class conference dentist dinner doctor exam flight haircut interview lecture lesson lunch meeting party photoshoot rehearsal session shift shoot standup training webinar wedding workout "
    "gym football yoga match game"
).split()
#: More verbs of errands, and more events.
MORE_VERBS = "assemble bathe come compare complete congratulate contact copy deposit dust enroll measure photograph prune pull rehearse remove reserve revise run serve show teach unpack work".split()
MORE_EVENTS = "presentation workshop brunch call concert".split()
VERBS = sorted({*TASK_VERBS, *MORE_VERBS} - {"check"})
EVENTS = [*EVENTS, *MORE_EVENTS]
#: Past tenses that a note may use for an order.
PASTS = {"called": "call", "texted": "text", "emailed": "email", "messaged": "message", "packed": "pack", "picked": "pick", "fixed": "fix", "cleaned": "clean", "cancelled": "cancel", "booked": "book", "ordered": "order", "washed": "wash", "printed": "print", "sent": "send"}
IRREGULAR = "paid bought went took got made brought gave wrote told met left found sold did drove ate sent built".split()


def any_of(words: list[str]) -> str:
    """A pattern that fits exactly these words, by common beginnings: an engine without tries looks at few branches."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    branches = [h + any_of(rest) for h, rest in heads.items() if h]
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
    return body + "?" if ends else body
