"""Reading person and organisation names as people type them."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

#: Short forms in common use and the names they stand for (fixed values).
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexandra", "andy": "andrew", "art": "arthur", "bea": "beatrice", "becky": "rebecca", "ben": "benjamin", "bert": "albert", "beth": "elizabeth",
    "betty": "elizabeth", "bill": "william", "bob": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher", "chuck": "charles", "cindy": "cynthia", "dan": "daniel", "danny": "daniel",
    "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "drew": "andrew", "don": "donald", "ed": "edward", "eddie": "edward", "fran": "frances", "frank": "francis", "fred": "frederick", "gabe": "gabriel",
    "gene": "eugene", "greg": "gregory", "hal": "henry", "hank": "henry", "harry": "henry", "hettie": "henrietta", "jack": "john", "jackie": "jacqueline", "jake": "jacob", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer",
    "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph", "johnny": "john", "jon": "jonathan", "josh": "joshua", "judy": "judith", "kate": "katherine", "kathy": "katherine", "katie": "katherine",
    "ken": "kenneth", "kim": "kimberly", "larry": "lawrence", "len": "leonard", "leo": "leonard", "liz": "elizabeth", "lou": "louis", "maggie": "margaret", "mandy": "amanda", "marge": "margaret", "matt": "matthew",
    "meg": "margaret", "mike": "michael", "mick": "michael", "molly": "mary", "nate": "nathaniel", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "pam": "pamela", "pat": "patricia", "patty": "patricia",
    "peg": "margaret", "peggy": "margaret", "pete": "peter", "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "russ": "russell", "sally": "sarah",
    "sam": "samuel", "sandy": "alexandra", "sasha": "alexandra", "steve": "steven", "sue": "susan", "ted": "edward", "teddy": "theodore", "terry": "teresa", "tim": "timothy", "toby": "tobias", "tom": "thomas", "tony": "anthony",
    "trish": "patricia", "vicky": "victoria", "vince": "vincent", "wally": "walter", "walt": "walter", "will": "william", "zach": "zachary",
}
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame phd md msc ba dipl ing rev hon jr sr".split())
SMALL = frozenset("for of the and in on to at de la le du des der die das für und et y von".split())
#: Words that say what kind of body an organisation is, with their short forms (fixed values).
KIND_WORDS = {
    "laboratory": "laboratory lab", "institute": "institute inst institut instituto", "centre": "centre center ctr cent", "observatory": "observatory obs", "association": "association assoc", "foundation": "foundation fdn found",
    "commission": "commission comm", "agency": "agency agcy", "university": "university univ", "department": "department dept", "council": "council", "committee": "committee", "society": "society soc", "network": "network",
    "school": "school", "group": "group", "office": "office", "ministry": "ministry min", "authority": "authority auth", "board": "board", "bureau": "bureau", "academy": "academy acad", "college": "college coll",
    "division": "division div", "forum": "forum", "federation": "federation fed", "union": "union", "alliance": "alliance", "initiative": "initiative", "unit": "unit", "service": "service", "corporation": "corporation corp", "company": "company",
}
KINDS = {short: word for word, all_forms in KIND_WORDS.items() for short in all_forms.split()}
INITIALS = re.compile(r"(?:[^\W\d_]\.[\s-]?)+[^\W\d_]?\.?$")


def fold(text: str) -> str:
    """Without case, accents and compatibility forms."""
    text = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in text if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("đ", "d")


class Name(NamedTuple):
    kind: str  # person or organisation
    core: str  # surname or proper name, folded
    code: str  # first initial, or the initials of an organisation's kind and field
    more: str  # further initials of a person
    given: str  # a person's given name, an organisation's kind, in full, if known


def _letters(token: str) -> str:
    return "".join(c for c in fold(token) if c.isalnum())


def read_person(text: str, given_names: frozenset[str]) -> Name | None:
    """``given_names``: folded given names as known from the collection and the table above."""
    text = " ".join(text.replace("’", "'").split())
    swapped = None
    if "," in text:
        last, _, first = text.partition(",")
        swapped = last.split(), first.split()
        tokens = [*first.split(), *last.split()]
    else:
        tokens = text.split()
    shouting = text.isupper()
    keep = [t for t in tokens if fold(t).strip(".") not in TITLES or len(tokens) < 3 and "." not in t]
    tokens = keep or tokens
    words = []
    order = []
    for t in tokens:
        bare = t.strip(".,;")
        short = INITIALS.match(t) and "." in t or len(bare) == 1 or len(bare) <= 3 and bare.isupper() and bare.isalpha() and not (shouting and fold(bare) in given_names)
        if short and _letters(t):
            order.append(("i", _letters(t)))
        elif _letters(t):
            words.append(t)
            order.append(("w", t))
    if not words:
        return None
    if swapped:
        surname_tokens = [t for t in swapped[0] if t in words] or words[-1:]
    elif len(words) == 1:
        surname_tokens = words
    else:
        known = [fold(w).strip(".,") in given_names for w in words]
        near = [k or _near(fold(w).strip(".,"), given_names) for k, w in zip(known, words)]
        if known[0] != known[-1]:
            surname_tokens = words[1:] if known[0] else words[:-1]
        elif near[0] != near[-1]:
            surname_tokens = words[1:] if near[0] else words[:-1]
        else:
            surname_tokens = words[1:]
        if len(surname_tokens) > 1:
            surname_tokens = [w for w in surname_tokens if fold(w).strip(".,") not in given_names] or surname_tokens
            surname_tokens = surname_tokens[-1:] if surname_tokens[-1:] != words[:1] else surname_tokens[:1]
    core = "".join(_letters(t) for t in surname_tokens)
    letters, full = "", ""
    for what, value in order:
        if what == "i":
            letters += value
        elif value not in surname_tokens:
            name = NICKNAMES.get(fold(value).strip(".,"), _letters(value))
            full = full or name
            letters += name[:1]
    return Name("person", core, letters[:1], letters[1:], full)


def _near(token: str, given_names: frozenset[str]) -> bool:
    """Whether one edit (a letter more, less, other or two swapped) makes the token a given name."""
    if len(token) < 4:
        return False
    splits = [(token[:i], token[i:]) for i in range(len(token) + 1)]
    if any(a + b[1:] in given_names for a, b in splits if b):
        return True
    if any(a + b[1] + b[0] + b[2:] in given_names for a, b in splits if len(b) > 1):
        return True
    letters = "abcdefghijklmnopqrstuvwxyz"
    return any(a + c + b[1:] in given_names for a, b in splits if b for c in letters) or any(a + c + b in given_names for a, b in splits for c in letters)


def read_organisation(text: str) -> Name | None:
    text = " ".join(text.replace("’", "'").split())
    proper = None
    m = re.search(r"\(([^()]+)\)\s*$", text)
    if m:
        proper, rest = m.group(1), text[: m.start()]
    elif "," in text:
        rest, _, proper = text.rpartition(",")
    if proper is not None and any(_letters(t) in KINDS for t in proper.split()):
        proper, rest = rest, proper
    if proper is None:
        tokens = [t for t in text.split() if fold(t).strip(".") != "the"]
        if not tokens:
            return None
        if len(tokens) == 1 and "-" in tokens[0]:
            head, _, tail = tokens[0].rpartition("-")
            if 1 < len(tail) <= 6 and tail.isupper():
                tokens = [head, tail]
        at = next((i for i, t in enumerate(tokens) if _letters(t) in KINDS), None)
        if at is not None and at > 0:
            proper, rest = " ".join(tokens[:at]), " ".join(tokens[at:])
        elif len(tokens) == 2 and tokens[1].isupper() and len(tokens[1]) <= 6 and not (tokens[0].isupper() and len(tokens[0]) <= 6):
            return Name("organisation", _letters(tokens[0]), _letters(tokens[1]), "", "")
        elif at == 0 and len(tokens) > 1:  # no proper name told apart: the last word is the best guess
            proper, rest = tokens[-1], " ".join(tokens[:-1])
        else:
            proper, rest = tokens[0], " ".join(tokens[1:])
    words = [w for w in re.split(r"[\s-]+", rest) if _letters(w)]
    code = "".join(_letters(w) if len(words) == 1 and w.isupper() and len(w) <= 6 else _letters(w)[:1] for w in words if fold(w).strip(".") not in SMALL)
    core = "".join(_letters(t) for t in re.split(r"[\s-]+", proper) if fold(t) != "the")
    kind = next((KINDS[_letters(w)] for w in words if _letters(w) in KINDS), "")
    return Name("organisation", core, code, "", kind) if core else None


def edits(a: str, b: str, most: int) -> int:
    """Letters to change, insert, delete or swap with a neighbour to get from a to b; anything over ``most`` comes out as more than it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            least = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                least = min(least, older[j - 2] + 1)
            row.append(least)
        if min(row) > most:
            return most + 1
    return row[-1]


def conflict(kind: str, a: str, b: str) -> bool:
    """Whether two given names, or kinds of organisation, rule out one bearer. Further initials don't: they come and go."""
    if not a or not b or a == b:
        return False
    if kind == "organisation":
        return True
    most = max(len(a), len(b)) // 2
    return edits(a, b, most) > most


def letter_pairs(core: str) -> list[str]:
    """Pairs of letters up to three apart, of a name between marks; characters beyond a-z and 0-9 fall into 64 classes, which bounds the number of pairs."""
    s = "^" + "".join(c if c.isascii() else chr(0x100 + ord(c) % 64) for c in core) + "$"
    return [s[i] + s[j] for i in range(len(s)) for j in range(i + 1, min(len(s), i + 4))]
