"""Names typed by people: tokens, roles and stand-ins."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Titles, suffixes, legal forms, words of trade names and their abbreviations, stand-ins, short names.
TITLES = frozenset("mr mrs ms miss mx dr prof rev reverend pastor fr father sister brother sir madam elder deacon bishop hon capt sgt".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md esq".split())
LEGAL = frozenset("llc inc incorporated ltd limited co company corp corporation plc lp llp gmbh sa".split())
ABBREVIATED = {
    "mgmt": "management", "mgt": "management", "grp": "group", "intl": "international", "int'l": "international", "assoc": "associates", "assocs": "associates",
    "assn": "association", "fdn": "foundation", "fndn": "foundation", "svcs": "services", "svc": "services", "srvcs": "services", "bros": "brothers",
    "const": "construction", "constr": "construction", "hdwe": "hardware", "hdw": "hardware", "hwd": "hardware", "fam": "family", "dent": "dental", "plumb": "plumbing", "plbg": "plumbing", "ctr": "center",
    "dept": "department", "univ": "university", "rfg": "roofing", "tech": "technologies",
}
TRADE = frozenset(
    "management group international associates association foundation services brothers construction hardware family dental plumbing roofing center ministries church trust bank school university "
    "department technologies partners holdings enterprises industries solutions consulting realty insurance properties electric motors auto bakery farms supply logistics media studio studios clinic "
    "pharmacy market grocery restaurant catering landscaping painting heating cooling cleaning security capital ventures systems design development fund society council club team committee".split()
)
STAND_INS = frozenset(
    "guest|guest guest|anonymous|anonymous anonymous|anonymous donor|anon|unknown|unknown unknown|n/a|na|n a|none|null|nil|test|test test|test user|first last|firstname lastname|facebook user|meta user|"
    "instagram user|user|visitor|no name|name|your name|full name|plate offering|plate|cash|cash offering|loose offering|loose plate|friend|friend friend|church friend|member|donor|giver|john doe|jane doe|"
    "asdf|asdf asdf|xxx|xxx xxx|x x|abc|abc abc|tbd|not provided|not given|prefer not to say|nobody|someone|somebody|a friend|online giver|walk in|family".split("|")
)
SHORT_NAMES = {
    "abby": "abigail", "abbie": "abigail", "gail": "abigail", "ada": "adaeze", "alex": "alexander", "xander": "alexander", "al": "albert", "andy": "andrew", "drew": "andrew", "tony": "anthony", "ant": "anthony",
    "babs": "barbara", "barb": "barbara", "barbie": "barbara", "bobbie": "barbara", "bea": "beatriz", "trixie": "beatriz", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "cal": "caleb", "charlie": "charles",
    "chuck": "charles", "chas": "charles", "chris": "christopher", "topher": "christopher", "kit": "christopher", "concha": "concepcion", "conchita": "concepcion", "connie": "concepcion", "cindy": "cynthia",
    "dan": "daniel", "danny": "daniel", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "lola": "dolores", "lolita": "dolores", "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward",
    "ellie": "eleanor", "nora": "eleanor", "nell": "eleanor", "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "betsy": "elizabeth", "eliza": "elizabeth", "libby": "elizabeth",
    "paco": "francisco", "pancho": "francisco", "cisco": "francisco", "fred": "frederick", "freddy": "frederick", "freddie": "frederick", "fritz": "frederick", "gabe": "gabriel", "gracie": "grace", "greg": "gregory",
    "lupe": "guadalupe", "lupita": "guadalupe", "nacho": "ignacio", "isa": "isabel", "izzy": "isabel", "bella": "isabel", "belle": "isabel", "bela": "isabel", "jackie": "jacqueline", "jacqui": "jacqueline", "jim": "james", "jimmy": "james", "jamie": "james",
    "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "jon": "jonathan", "jonny": "jonathan", "johnny": "jonathan", "nathan": "nathaniel", "nate": "nathaniel", "nat": "nathaniel", "pepe": "jose", "joe": "joseph", "joey": "joseph",
    "josie": "josephine", "jo": "josephine", "jc": "juancarlos", "juanca": "juancarlos", "juanc": "juancarlos", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kathie": "katherine", "kitty": "katherine",
    "ken": "kenneth", "kenny": "kenneth", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "marge": "margaret", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "rita": "margaret",
    "marc": "marcus", "matt": "matthew", "matty": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael", "mikey": "michael", "nati": "natalia", "talia": "natalia", "nick": "nicholas", "nicky": "nicholas", "nico": "nicholas",
    "ozzie": "oscar", "pam": "pamela", "pammy": "pamela", "pat": "patricia", "patty": "patricia", "patti": "patricia", "trish": "patricia", "tricia": "patricia", "penny": "penelope", "phil": "philip", "pip": "philip", "rafa": "rafael", "rafi": "rafael",
    "becky": "rebecca", "becca": "rebecca", "bec": "rebecca", "rich": "richard", "rick": "richard", "ricky": "richard", "dick": "richard", "richie": "richard", "rob": "robert", "bob": "robert", "bobby": "robert", "robbie": "robert", "bert": "robert",
    "ron": "ronald", "ronnie": "ronald", "ruthie": "ruth", "sam": "samuel", "sammy": "samuel", "si": "silas", "steve": "stephen", "stevie": "stephen", "steph": "stephen", "sue": "susan", "susie": "susan", "suzy": "susan", "suzie": "susan",
    "theo": "theodore", "teddy": "theodore", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "timmy": "timothy", "toby": "tobias", "val": "valerie", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vince": "vincent", "vinny": "vincent", "vin": "vincent",
    "bill": "william", "billy": "william", "will": "william", "willy": "william", "willie": "william", "liam": "william", "alexa": "alexandra", "sandra": "alexandra", "lexi": "alexandra", "sandy": "alexandra", "molly": "maryann", "mae": "maryann", "naya": "naomi", "zo": "zoe", "coco": "chloe", "clo": "chloe",
}

PARSED = StructType([StructField(c, StringType()) for c in ("kind", "g1", "f1", "g2", "f2")])
_QUOTED = re.compile(r"[\"“”'‘’(][^\"“”'‘’()]+[\"“”'‘’)]")
_CAMEL = re.compile(r"[A-ZÀ-Ý][a-zà-ÿ\-]{2,}(?:[A-ZÀ-Ý][a-zà-ÿ\-]{2,}){1,2}")
_PART = re.compile(r"[A-ZÀ-Ý][a-zà-ÿ\-]+?(?=[A-ZÀ-Ý](?<!-.)|$)")


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def parse_name(name: str | None) -> tuple[str, str | None, str | None, str | None, str | None]:
    """``kind`` and two readings (given, family) of a typed name: as written and turned round.

    kind: ``none`` (blank), ``standin``, ``email`` (an address typed as a name), ``org``, ``person``.
    Given names of two words are joined; a middle initial, a title and a quoted short name are left
    out. One letter stands for an initial. The second reading is NULL where a comma settles the order.
    """
    nothing = (None,) * 4
    text = (name or "").strip()
    if not text:
        return ("none", *nothing)
    if "@" in text:
        return ("email", *nothing)
    plain = " ".join(folded(text).split())
    if plain.strip(" .-_*?!") in STAND_INS or not re.search(r"[^\W\d_]", plain):
        return ("standin", *nothing)
    if _CAMEL.fullmatch(text):
        text = " ".join(_PART.findall(text))
    text = _QUOTED.sub(" ", f" {text} ") if _QUOTED.sub(" ", f" {text} ").strip() else text
    head, comma, tail = folded(text).partition(",")
    words = lambda s: [w for w in (re.sub(r"[^\w]", "", x) for x in s.replace("&", " ").replace("/", " ").split()) if w and w != "and"]
    left, right = words(head), words(tail)
    every = [ABBREVIATED.get(w, w) for w in left + right]
    trade = [w for w in every if w in TRADE]
    legal = any(w in LEGAL for w in every)
    if legal or trade and len(every) - len(trade) <= 2:
        own = sorted(w for w in every if w not in TRADE and w not in LEGAL)
        return ("org", "#" + " ".join(sorted(trade)), "".join(own) or None, None, None)
    clean = lambda ws: [w for w in ws if w not in TITLES and w not in SUFFIXES] or ws
    left, right = clean(left), [w for w in right if w not in SUFFIXES and w not in TITLES]
    fixed = bool(right)
    if not (tokens := right + left):
        return ("standin", *nothing)
    if len(tokens) == 1:
        g = tokens[0]
        return ("person", SHORT_NAMES.get(g, g), None, None, None)

    def given(ws: list[str]) -> str:
        full = [w for w in ws if len(w) > 1]
        g = "".join(full) if full and (len(ws[0]) > 1 or not full) else ws[0]
        return SHORT_NAMES.get(g, g)

    if fixed:
        return ("person", given(right), "".join(w for w in left if len(w) > 1) or left[0], None, None)
    return ("person", given(tokens[:-1]), tokens[-1], given(tokens[1:]), tokens[0])


@F.pandas_udf(PARSED)
def parsed(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(x) for x in names], columns=["kind", "g1", "f1", "g2", "f2"])
