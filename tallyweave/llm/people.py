"""Who a record was written for: one key per person or organisation over noisy names and contacts.

``identify`` takes records ``name, email, phone, pid`` and gives each the columns

* ``given, family``   canonical name key (NULL where nothing tells),
* ``key``             the name key, or one built on a contact for nameless records,
* ``entity``          the person: the key, divided where several people share the name,
* ``e, p, s, d, pattern``  e-mail, phone, local number and person id in plain form, and how the mailbox spells the name.

A name key comes from the name itself (spellings linked by the trie join and checked per pair of
names, in either order of the words), else from other records with the same contact and a name that
agrees with what is written, else from the mailbox name, else from the only full name an initial can
stand for. People of one household share contacts but not name keys, so contacts never join two
different names; within one name key contacts, person ids and mailbox patterns tell namesakes apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import plain_id
from ..runtime import stable
from .names import parsed
from .spelling import ranked_neighbours, usual_spelling

#: A spelling yields to one written so many times as often, where another part of the name agrees, and where nothing else does.
RATIO, RATIO_ALONE = 3, 10

# Mailboxes and numbers typed to get past a form.
FAKE_BOXES = "test|guest|none|na|noemail|no|nomail|null|unknown|anonymous|user|email|example|fake|asdf|abc|xxx|nobody|someone|donotreply|noreply|nowhere"
FAKE_PHONES = ("1234567890", "0123456789", "9876543210", "0987654321", "1231231234", "1112223333")


def _clean_email(c: Column) -> Column:
    v = F.lower(F.regexp_replace(c, r"(?U)[\s\p{Cc}\p{Cf}]+", ""))
    v = F.regexp_replace(v, r",", ".")
    v = F.regexp_replace(v, r"^\.+|\.+$|\.+(?=@)|(?<=@)\.+", "")
    return F.regexp_replace(F.regexp_replace(v, r"\.{2,}", "."), r"\+[^@]*(?=@)", "")


def is_fake_email(v: Column) -> Column:
    """Of a cleaned address: a mailbox that repeats its host, or one of the usual stand-ins."""
    box = F.regexp_replace(F.substring_index(v, "@", 1), r"[^a-z]", "")
    host = F.substring_index(F.substring_index(v, "@", -1), ".", 1)
    return box.rlike(f"^({FAKE_BOXES})$") & (v.contains("@").__invert__() | (box == host) | box.rlike("^(test|guest|none|na|noemail|nomail|null|unknown|anonymous|fake|asdf|xxx|noreply|donotreply)$"))


def usable_email(c: Column) -> Column:
    """The cleaned address (lower case, no spaces, no +tag, comma for dot mended), or NULL.

    Usable: an ``@``, something before it, a dot after the last ``@`` and not a stand-in.
    """
    v = _clean_email(c)
    return F.when(v.rlike(r"^[^@]+@[^@]*[^@.]\.[^@.]+$") & ~is_fake_email(v), v)


def kept_email(c: Column) -> Column:
    """The address as stored if it can be written to as it stands (``@``, a dot after the last one, no stand-in), or NULL."""
    return F.when(F.substring_index(c, "@", -1).contains(".") & c.contains("@") & ~is_fake_email(_clean_email(c)), c)


def is_fake_phone(ten: Column) -> Column:
    return ten.rlike(r"^(\d)\1{9}$") | ten.isin(*FAKE_PHONES)


def usable_phone(c: Column) -> Column:
    """Ten digits of a phone number (country code, punctuation, extension dropped), or NULL."""
    main = F.regexp_replace(F.lower(c), r"\s*(x|ext\.?|extension|#)\s*\d+\s*$", "")
    digits = F.regexp_replace(main, r"[^0-9]", "")
    ten = F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))
    return F.when(~is_fake_phone(ten), ten)


def local_phone(c: Column) -> Column:
    """Last seven digits of a phone number of seven digits or more, or NULL; evidence for matching, not a usable value.

    A number noted without its area code agrees in these with the full one.
    """
    main = F.regexp_replace(F.lower(c), r"\s*(x|ext\.?|extension|#)\s*\d+\s*$", "")
    digits = F.regexp_replace(main, r"[^0-9]", "")
    seven = F.right(digits, F.lit(7))
    fake = seven.rlike(r"^(\d)\1{6}$") | seven.isin("1234567", *[x[-7:] for x in FAKE_PHONES]) | is_fake_phone(F.right(digits, F.lit(10)))
    return F.when((F.length(digits) >= 7) & ~fake, seven)


def own_contact(email: Column, phone: Column) -> Column:
    """Whether there is an e-mail or phone, however written, that is neither blank nor a stand-in."""
    e, digits = _clean_email(email), F.regexp_replace(phone, r"[^0-9]", "")
    fake = is_fake_phone(F.right(digits, F.lit(10))) | digits.rlike(r"^(\d)\1*$") | (digits == "1234567")
    return F.coalesce((e != "") & e.contains("@") & ~is_fake_email(e), F.lit(False)) | F.coalesce((F.length(digits) >= 7) & ~fake, F.lit(False))


PROFILE = ("name", "email", "phone", "pid")


def _profile_id(scope: Column) -> Column:
    """128 bits of the values that make a profile; NULL differs from any text."""
    return F.md5(F.to_json(F.struct(scope.alias("scope"), *PROFILE)))


def _turned(p: DataFrame, given: DataFrame) -> DataFrame:
    """``name, kind, g, f``: of the two orders of a name's words the one that other names bear out.

    The order as written stays unless the turned one reads a given name that is more usual and makes
    a name that is written elsewhere, or is ``RATIO_ALONE`` times as usual.
    """
    as_given = lambda c, to, n: given.select(F.col("word").alias(c), F.col("canon").alias(to), F.col("n").alias(n))
    # One letter, and the trade words of an organisation ("#..."), are no words of the trie.
    plain = lambda c, to: F.when((F.length(c) == 1) | F.col(c).startswith("#"), F.col(c)).otherwise(F.col(to))
    t = p.join(as_given("g1", "c1", "n1"), "g1", "left").join(as_given("g2", "c2", "n2"), "g2", "left").withColumns({"c1": plain("g1", "c1"), "c2": plain("g2", "c2")})
    known = t.where((F.length("c1") > 1) & (F.length("f1") > 1)).groupBy(F.col("c1").alias("c2"), F.col("f1").alias("f2")).agg(F.lit(True).alias("borne"))
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    turn = (F.col("kind") == "person") & (F.length("g1") > 1) & F.col("f2").isNotNull() & ((F.col("borne").isNotNull() & (n2 > n1)) | (n2 >= RATIO_ALONE * F.greatest(n1, F.lit(1))))
    turn = F.coalesce(turn, F.lit(False))
    return t.join(known, ["c2", "f2"], "left").select("name", "kind", F.when(turn, F.col("c2")).otherwise(F.col("c1")).alias("g"), F.when(turn, F.col("f2")).otherwise(F.col("f1")).alias("f"))


def _mend_pairs(names: DataFrame, near: DataFrame) -> DataFrame:
    """``g, f, tg, tf``: names one edit in one word away from a name with a more usual spelling of it.

    Candidates come from the trie; each is checked: the name with that word and the same other word
    (or its initial) must be written too, and the word must be ``RATIO`` times as usual, unless the
    one that yields is borne by nobody else. Each step goes up in usage, so chains end; they are
    followed by doubling.
    """
    pairs = names.where(F.col("g").isNotNull() & (F.length("f") > 1)).select("g", "f").distinct()
    there = pairs.unionByName(pairs.select(F.left("g", F.lit(1)).alias("g"), "f")).distinct()
    near = near.where((F.col("a") != F.col("b")) & (F.struct("nb", "b") > F.struct("na", "a")))
    alone = lambda c, o, tag: pairs.where((F.length("g") > 1)).groupBy(c).agg(F.min(o).alias("lo"), F.max(o).alias("hi")).select(F.lit(tag).alias("tag"), F.col(c).alias("a"), (F.col("lo") == F.col("hi")).alias("alone"))
    near = near.join(alone("f", "g", "f").unionByName(alone("g", "f", "g")), ["tag", "a"], "left").where((F.col("nb") >= RATIO * F.greatest("na", F.lit(1))) | F.coalesce("alone", F.lit(True)))
    by = lambda tag, c, to: near.where(F.col("tag") == tag).select(F.col("a").alias(c), F.col("b").alias(to), "nb")
    cand = pairs.join(by("f", "f", "tf"), "f").select("g", "f", F.col("g").alias("tg"), "tf", "nb").unionByName(
        pairs.where(F.length("g") > 1).join(by("g", "g", "tg"), "g").select("g", "f", "tg", F.col("f").alias("tf"), "nb")
    )
    good = cand.join(there.select(F.col("g").alias("tg"), F.col("f").alias("tf")), ["tg", "tf"], "left_semi")
    step = stable(good.groupBy("g", "f").agg(F.max_by(F.struct("tg", "tf"), F.struct("nb", "tg", "tf")).alias("t")).select("g", "f", "t.tg", "t.tf"))
    while True:
        ahead = step.select(F.col("g").alias("tg"), F.col("f").alias("tf"), F.col("tg").alias("ug"), F.col("tf").alias("uf"))
        step = stable(step.join(ahead, ["tg", "tf"], "left").select("g", "f", F.coalesce("ug", "tg").alias("tg"), F.coalesce("uf", "tf").alias("tf"), F.col("ug").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.drop("moved")
        step = step.drop("moved")


def _own_box(box: Column, g: Column, f: Column) -> Column:
    """Whether the letters of a mailbox name spell this given and family name, as far as short forms go."""
    letters = F.regexp_replace(box, "[^a-z]", "")
    return letters.contains(F.left(f, F.lit(4))) & (letters.contains(g) | (F.left(letters, F.lit(1)) == F.left(g, F.lit(1))) | g.startswith("#"))


def _pattern(g: Column, f: Column) -> Column:
    """How a mailbox spells its owner's name: order of the words, marks between them, number or host; NULL if it doesn't."""
    digits = F.regexp_extract("box", r"(\d+)$", 1)
    own = F.col("e").isNotNull() & g.isNotNull() & f.isNotNull() & _own_box(F.col("box"), g, f)
    order = F.when(F.col("box").startswith(F.left(f, F.lit(4))), "f").otherwise("g")
    return F.when(own, F.concat_ws("/", order, F.regexp_replace("box", "[^._-]", ""), F.when(digits != "", digits).otherwise(F.col("host"))))


def _contacts() -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(c + ":"), F.col(c))) for c in ("e", "p", "s", "d")])))


def _mend_on_contact(prof: DataFrame) -> DataFrame:
    """``g, f, tg, tf``: full names of one contact that share one word and are two edits apart in the other.

    The rarer spelling yields. A given name yields only if it is rare beside the other one anywhere
    (``RATIO``): two usual given names on one contact are two people of a household.
    """
    full = prof.where((F.length("g") > 1) & (F.length("f") > 1))
    usual = full.groupBy("g", "f").agg(F.sum("rows").alias("total"), F.count_distinct("name").alias("names"))
    given = full.groupBy("g").agg(F.count_distinct("name").alias("ng"))
    held = full.select("g", "f", _contacts().alias("c")).distinct().join(usual, ["g", "f"]).join(given, "g")
    side = F.explode(F.array(*[F.struct(F.lit(x).alias("by"), F.col(x).alias("same"), F.col(o).alias("other")) for x, o in (("g", "f"), ("f", "g"))]))
    held = stable(held.select("c", "g", "f", "names", "total", "ng", side.alias("s")).select("c", "g", "f", "names", "total", "ng", "s.*"))
    top = held.groupBy("c", "by", "same").agg(F.max(F.struct("names", "total", "g", "f", "ng")).alias("w"), F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").drop("lo", "hi")
    to = F.when(F.col("by") == "g", F.col("w.f")).otherwise(F.col("w.g"))
    rare = (F.col("by") == "g") | (F.col("w.ng") >= RATIO * F.col("ng"))
    near = held.join(top, ["c", "by", "same"]).where((F.col("other") != to) & (F.length("other") > 3) & (F.levenshtein(F.col("other"), to, 2) >= 0) & rare)
    return near.groupBy("g", "f").agg(F.max("w").alias("t")).select("g", "f", F.col("t.g").alias("tg"), F.col("t.f").alias("tf"))


def _told(prof: DataFrame) -> DataFrame:
    """``pid_, kg, kf``: the full name a profile with part of a name, or none, stands for.

    Every kind of evidence is a string that full names put into one index; a string that stands for
    two names tells nothing. Ranks: 1 a contact and what is written of the name, 2 the mailbox,
    3 a contact alone, 4 the only full name an initial can stand for.
    """
    k = F.struct("g", "f")
    full = prof.where((F.length("g") > 1) & (F.length("f") > 1))
    say = lambda tag, *x: F.concat_ws("\x1f", F.lit(tag), *x)
    on = full.select("g", "f", _contacts().alias("c")).distinct().withColumns({"gi": F.left("g", F.lit(1)), "fi": F.left("f", F.lit(1))})
    keys = full.select("g", "f").distinct().withColumns({"gi": F.left("g", F.lit(1)), "f6": F.left("f", F.lit(6))})
    index = (
        on.select(k.alias("k"), F.explode(F.array(say("ci", "c", "f", "gi"), say("cs", "c", "g", "fi"), say("ca", "c", "g"), say("cn", "c"))).alias("ev"))
        .unionByName(keys.select(k.alias("k"), F.explode(F.array(say("b6", "g", "f6"), say("bi", "gi", "f"))).alias("ev")))
        .groupBy("ev").agg(F.min("k").alias("k"), F.max("k").alias("k2")).where("k = k2").select("ev", "k")
    )
    part = prof.where(~((F.length("g") > 1) & (F.length("f") > 1)) | F.col("g").isNull() | F.col("f").isNull())
    part = part.withColumns({"gi": F.left("g", F.lit(1)), "fi": F.left("f", F.lit(1)), "g": F.when(F.length("g") > 1, F.col("g")), "f": F.when(F.length("f") > 1, F.col("f"))})
    words = F.filter(F.split(F.regexp_replace("box", r"[0-9]+", ""), r"[._\-]"), lambda w: F.length(w) >= 3)
    one, two = F.size("w") == 1, F.size("w") == 2
    w0, w1 = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    has_f, nameless = F.col("f").isNotNull(), F.col("gi").isNull() & F.col("fi").isNull()
    ev = lambda rank, cond, *x: F.when(cond, F.struct(F.lit(rank).alias("rank"), F.concat_ws("\x1f", *x).alias("ev")))
    six = lambda c: F.left(c, F.lit(6))
    by_contact = part.select("pid_", "g", "f", "gi", "fi", _contacts().alias("c")).select("pid_", "g", "f", "gi", "fi", F.explode(F.array_compact(F.array(
        ev(1, has_f & F.col("gi").isNotNull(), F.lit("ci"), "c", "f", "gi"), ev(1, F.col("g").isNotNull() & ~has_f & F.col("fi").isNotNull(), F.lit("cs"), "c", "g", "fi"),
        ev(1, F.col("g").isNotNull() & F.col("fi").isNull(), F.lit("ca"), "c", "g"), ev(3, nameless, F.lit("cn"), "c"),
    ))).alias("x"))
    by_name = part.withColumn("w", words).select("pid_", "g", "f", "gi", "fi", F.explode(F.array_compact(F.array(
        ev(2, two, F.lit("b6"), w0, six(w1)), ev(2, two, F.lit("b6"), w1, six(w0)), ev(2, one & (F.length(w0) > 4), F.lit("bi"), F.left(w0, F.lit(1)), F.expr("substring(w[0], 2)")),
        ev(4, has_f & F.col("gi").isNotNull(), F.lit("bi"), "gi", "f"),
    ))).alias("x"))
    agrees = (F.col("g").isNull() | (F.col("g") == F.col("k.g"))) & (F.col("f").isNull() | (F.col("f") == F.col("k.f"))) & (F.col("gi").isNull() | (F.col("gi") == F.left("k.g", F.lit(1)))) & (F.col("fi").isNull() | (F.col("fi") == F.left("k.f", F.lit(1))))
    best = by_contact.unionByName(by_name).select("pid_", "g", "f", "gi", "fi", "x.rank", "x.ev").join(index, "ev").where(agrees).groupBy("pid_", "rank").agg(F.min("k").alias("k"), F.max("k").alias("k2"))
    first = best.groupBy("pid_").agg(F.min_by(F.struct("k", "k2"), "rank").alias("t"))
    return first.where("t.k = t.k2").select("pid_", F.col("t.k.g").alias("kg"), F.col("t.k.f").alias("kf"))


def identify(records: DataFrame, within: str | None = None, one_phone: bool = False) -> DataFrame:
    """See the module. ``records`` keeps its columns; clashing names of the result are replaced.

    ``within`` names a column (a table, say): spellings and evidence are read over all records, but
    entities are then formed in each of its values alone and shared by none. With ``one_phone`` two
    phones of one name mean two people, unless an address or an id joins them; else people may have
    several.
    NULLs in any column, repeated rows and empty tables are allowed. A record with neither name nor
    contact nor person id gets ``entity`` NULL.
    """
    scope = F.col(within) if within else F.lit("")
    base = records.select(*PROFILE, scope.alias("scope"))
    names = base.where(F.col("name").isNotNull()).select("name").distinct()
    p = stable(names.repartition("name").withColumn("p", parsed("name")).select("name", "p.*"))
    fake = is_fake_email(_clean_email(F.col("email")))
    prof = (
        base.groupBy(*PROFILE, "scope").agg(F.count(F.lit(1)).alias("rows"))
        .withColumns({"e": usable_email(F.col("email")), "p": usable_phone(F.col("phone")), "s": local_phone(F.col("phone")), "d": plain_id(F.col("pid")), "pid_": _profile_id(F.col("scope"))})
        .withColumns({"box": F.when(~fake, F.substring_index(_clean_email(F.col("email")), "@", 1)), "host": F.when(F.col("e").isNotNull(), F.substring_index("e", "@", -1))})
    )
    prof = stable(prof)
    word = lambda c, tag, n: p.where(F.col("kind").isin("person", "org") & F.col(c).isNotNull() & (F.length(c) > 1) & ~F.col(c).startswith("#")).select(F.lit(tag).alias("tag"), F.col(c).alias("word"), F.lit(n).alias("n"))
    vocab = word("g1", "g", 1).unionByName(word("g2", "g", 0)).unionByName(word("f1", "f", 1)).unionByName(word("f2", "f", 0)).unionByName(
        prof.where(F.col("host").isNotNull()).select(F.lit("h").alias("tag"), F.col("host").alias("word"), F.lit(1).alias("n"))
    )
    near = stable(ranked_neighbours(vocab))
    usual = usual_spelling(near.where(F.col("tag") != "f"), RATIO_ALONE)
    # Families come through the trie, too: a word it doesn't hand on makes no name.
    read = stable(_turned(p, usual.where("tag = 'g'")).join(near.where("tag = 'f' AND a = b").select(F.col("a").alias("f"), F.lit(True).alias("seen")), "f", "left"))
    read = read.withColumn("f", F.when((F.length("f") == 1) | F.col("seen"), F.col("f"))).drop("seen")
    mend = _mend_pairs(read, near)
    named = read.join(mend, ["g", "f"], "left").select("name", "kind", F.coalesce("tg", "g").alias("g"), F.coalesce("tf", "f").alias("f"))
    hosts = usual.where("tag = 'h'").select(F.col("word").alias("host"), F.col("canon").alias("chost"))
    who = F.col("kind").isin("person", "org")
    prof = prof.join(named, "name", "left").join(hosts, "host", "left").select(
        "pid_", *PROFILE, "scope", "rows", F.when(F.col("e").isNotNull(), F.concat("box", F.lit("@"), "chost")).alias("e"), "p", "s", "d", "box", F.col("chost").alias("host"), "kind", F.when(who, F.col("g")).alias("g"), F.when(who, F.col("f")).alias("f")
    )
    prof = stable(prof)
    prof = stable(prof.join(_mend_on_contact(prof), ["g", "f"], "left").withColumns({"g": F.coalesce("tg", "g"), "f": F.coalesce("tf", "f")}).drop("tg", "tf"))
    prof = prof.join(_told(prof), "pid_", "left").withColumns({"gi": F.left("g", F.lit(1)), "fi": F.left("f", F.lit(1))})
    known = F.col("kg").isNotNull() | ((F.length("g") > 1) & (F.length("f") > 1))
    prof = prof.withColumns({"given": F.when(known, F.coalesce("kg", "g")), "family": F.when(known, F.coalesce("kf", "f"))})
    lone = F.coalesce(F.concat(F.lit("@"), F.coalesce("d", "e")), F.concat(F.lit("@"), F.coalesce("p", "s"), F.lit("|"), F.coalesce("gi", F.lit("")), F.coalesce("fi", F.lit(""))), F.when(F.col("kind").isin("person", "org") & F.col("g").isNotNull(), F.concat(F.lit("?"), F.col("name"))))
    prof = stable(prof.withColumn("key", F.when(known, F.concat_ws("|", "given", "family")).otherwise(lone)).select("pid_", "scope", "given", "family", "key", "e", "p", "s", "d", _pattern(F.col("given"), F.col("family")).alias("pattern"), "kind"))
    out = ("given", "family", "key", "entity", "e", "p", "s", "d", "pattern", "kind")
    keyed = prof.join(_namesakes(prof, ("d", "sig", "s") if one_phone else ("d", "sig")), "pid_", "left").select("pid_", *out)
    return records.drop(*out).withColumn("pid_", _profile_id(scope)).join(keyed, "pid_").drop("pid_")


def _namesakes(prof: DataFrame, tell: tuple[str, ...]) -> DataFrame:
    """``pid_, entity``: profiles of one key (and scope), divided where its records are of several people.

    Profiles that share a contact, a person id, a mailbox pattern, or a phone or mailbox but for one
    letter, are joined (smallest label over shared evidence and over the label's own label, repeated
    until nothing changes). A key stays whole unless two of the pieces have one of the columns
    ``tell`` each: a person id, a mailbox of its own name, a phone.
    """
    base = prof.where(F.col("key").isNotNull()).select("pid_", F.concat_ws("\x1f", "scope", "key").alias("key"), "e", "p", "s", "d", F.col("pattern").alias("sig"), F.substring_index("e", "@", 1).alias("box"))
    two = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    count = base.groupBy("key").agg(reduce(Column.__or__, map(two, tell)).alias("two")).where("two").select("key")
    many = stable(base.join(count, "key", "left_semi"))
    tag = lambda t, c: F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit(t), F.col(c))))
    # One letter more, less, other or swapped: two such strings meet in what is left without a letter.
    less = lambda t, c: F.when(F.length(c) > 3, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.lit(t), F.left(F.col(c), i - 1), F.substr(F.col(c), i + 1))))
    node = F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(
        tag("s:", "sig"), F.when(F.col("sig").isNull(), F.array(F.concat(F.lit("e:"), F.col("e")))), tag("p:", "p"), tag("l:", "s"), tag("d:", "d"), less("l:", "s"), tag("b:", "box"), less("b:", "box"),
    )))))
    links = stable(many.select("pid_", "key", node.alias("node")).where("node is not null").select("pid_", F.concat_ws("\x1f", "key", "node").alias("node")))
    label = many.select("pid_", F.col("pid_").alias("label"))
    while True:
        low = links.join(label, "pid_").groupBy("node").agg(F.min("label").alias("low"))
        new = links.join(low, "node").groupBy("pid_").agg(F.min("low").alias("new"))
        far = label.join(new, "pid_", "left").select("pid_", "label", F.least("label", "new").alias("new"))
        jump = far.select(F.col("pid_").alias("new"), F.col("new").alias("newer"))
        step = stable(far.join(jump, "new").select("pid_", F.col("newer").alias("label"), (F.col("newer") < F.col("label")).alias("moved")))
        label = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    # Of a key whose pieces don't conflict all are one. Else pieces without an identity of their own go to the only one that has one.
    piece = stable(many.join(label, "pid_").select("pid_", "key", "label", *[F.col(c).isNotNull().alias(c) for c in tell]))
    named = reduce(Column.__or__, map(F.col, tell))
    each = piece.groupBy("key", "label").agg(*[F.max(c).alias(c) for c in tell])
    whole = each.groupBy("key").agg(F.greatest(*[F.count_if(c) for c in tell]).alias("most"), F.min("label").alias("least"), *[f(F.when(named, F.col("label"))).alias(n) for n, f in (("only", F.min), ("last", F.max))])
    to = F.when(F.col("most") <= 1, F.col("least")).when(~named & (F.col("only") == F.col("last")), F.col("only")).otherwise(F.col("label"))
    goes = each.join(whole, "key").select("key", "label", to.alias("to"))
    divided = piece.join(goes, ["key", "label"]).select("pid_", F.col("to").alias("label"))
    return prof.where(F.col("key").isNotNull()).select("pid_", F.concat_ws("\x1f", "scope", "key").alias("key")).join(divided, "pid_", "left").select("pid_", F.concat_ws("#", "key", "label").alias("entity"))
