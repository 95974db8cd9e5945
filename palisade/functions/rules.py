"""Rules, heuristic features and signals over the detection view of a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import lexicon as L, text as T


def may_hit(anchors: list[str], low: Column) -> Column:
    """Whether a text in lower case can match a pattern with these anchors: a search for plain words."""
    groups = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in g.split()]) for g in anchors]
    odd = [F.contains(low, F.lit(c)) for c in {*L.ODD_CASE, *"\u0130".lower()[1:]}]
    return reduce(lambda a, b: a & b, groups) | reduce(lambda a, b: a | b, odd)


#: The number of each pattern's bit where it is known which can occur in a text (``grams.may``), and how many places
#: higher the bit is that says that it does.
BIT, SURE = {n: i for i, n in enumerate([*L.PATTERNS, *L.CASED])}, 32


def _can(name: str, may: Column, sure: bool = False) -> Column:
    return may.bitwiseAND(F.lit(1 << BIT[name] + SURE * sure)) != 0


def hit(name: str, view: Column, low: Column | None = None, may: Column | None = None) -> Column:
    """Whether a pattern of the lexicon occurs; low: the view in lower case, may: the bits of patterns that can, if at hand."""
    cased = name in L.CASED
    found = view.rlike(L.java(L.CASED[name] if cased else L.PATTERNS[name], cased))
    if may is not None:
        return F.when(_can(name, may, sure=True), F.lit(True)).when(_can(name, may), found).otherwise(F.lit(False))
    return found if low is None or name not in L.ANCHORS else may_hit(L.ANCHORS[name], low) & found


def count(name: str, view: Column, may: Column | None = None) -> Column:
    """How often a pattern of the lexicon occurs."""
    cased = name in L.CASED
    found = F.regexp_count(view, F.lit(L.java(L.CASED[name] if cased else L.PATTERNS[name], cased)))
    return found if may is None else F.when(_can(name, may), found).otherwise(F.lit(0))


def noisy_or(weights: list[Column]) -> Column:
    """1 - prod(1 - w); a null weight did not fire."""
    return F.lit(1.0) - reduce(lambda a, w: a * (F.lit(1.0) - F.coalesce(w, F.lit(0.0))), weights, F.lit(1.0))


def external_destination(view: Column) -> Column:
    """Whether a URL or an address points to a host without an internal name in it."""

    def outside(hosts):
        return F.exists(hosts, lambda h: ~reduce(lambda a, b: a | b, [F.contains(h, F.lit(x)) for x in L.RULE_INTERNAL]))

    urls = F.transform(F.regexp_extract_all(view, F.lit(L.java(L.PATTERNS["url"])), F.lit(0)), lambda u: F.lower(F.substring_index(F.regexp_replace(u, "^[^/]*//", ""), "/", 1)))
    mails = F.transform(F.regexp_extract_all(view, F.lit(L.java(L.CASED["email"], True)), F.lit(0)), lambda e: F.lower(F.regexp_replace(e, "^[^@]*@", "")))
    return outside(urls) | outside(mails)


def _clauses(view: Column, verbs: str) -> Column:
    """The clause that starts at each verb; clauses may overlap."""
    windows = F.regexp_extract_all(view, F.lit(r"(?imduU)(?=(" + L.PATTERNS[verbs] + r"[\s\S]{0,200}))"), F.lit(1))
    return F.transform(windows, T.clause)


def exfil_weight(view: Column) -> Column:
    """The weight of an exfiltration clause, or null."""
    strong, weak = L.EXFIL_WEIGHTS
    both = F.exists(_clauses(view, "exfil_verb"), lambda c: hit("credential", c) & external_destination(c))
    one = F.exists(_clauses(view, "strong_exfil_verb"), lambda c: hit("credential", c) | external_destination(c))
    return F.when(both, F.lit(strong)).when(one, F.lit(weak))


def with_rules(df: DataFrame, raw: str, view: str, into: str, exfil: bool = True, anchored: bool = False, may: Column | None = None) -> DataFrame:
    """Adds ``into``: fired rules as an array of (weight, name, description), in rule order.

    anchored: search for plain words before patterns, which is faster over whole texts and makes a
    larger plan.  may: the bits of patterns that can occur, if at hand.
    """
    names = ["override", "multilingual", "role_tokens", "new_policy", "jailbreak", "payload", "tool_trigger", "credential", "coercion", "secrecy", "exfil_verb"]
    flag = {n: f"_{into}_{n}" for n in names}
    low = f"_{into}_low"
    if anchored:
        df = df.withColumn(low, F.lower(view))
    df = df.withColumns({c: hit(n, F.col(view), F.col(low) if anchored else None, may) for n, c in flag.items()}).drop(low)
    h = {n: F.col(c) for n, c in flag.items()}
    special = {
        "hidden_chars_raw": T.has_hidden(F.col(raw)),
        "tool_hijack": h["tool_trigger"] & (h["override"] | h["credential"] | h["coercion"]),
        "stealth_instruction": h["secrecy"] & (h["exfil_verb"] | h["tool_trigger"] | h["override"]),
    }
    every = []
    for name, weight, text, pattern in L.RULES:
        if name == "exfil_instruction":
            w = F.when(h["exfil_verb"], exfil_weight(F.col(view))) if exfil else F.lit(None).cast("double")
        else:
            w = F.when(special[name] if pattern is None else h[pattern], F.lit(weight))
        every.append(F.struct(w.alias("weight"), F.lit(name).alias("name"), F.lit(text).alias("description")))
    return df.withColumn(into, F.filter(F.array(*every), lambda x: x["weight"].isNotNull())).drop(*flag.values())


def rule_score(hits: Column) -> Column:
    """The noisy-or of fired rules."""
    return F.aggregate(hits, F.lit(1.0), lambda a, x: a * (F.lit(1.0) - x["weight"]), lambda a: F.lit(1.0) - a)


def heaviest(hits: Column, k: int = 4) -> Column:
    """Descriptions of the heaviest rules; rules of one weight keep their order."""
    order = F.array_sort(F.transform(hits, lambda x, i: F.struct((-x["weight"]).alias("w"), i.alias("i"), x["description"].alias("d"))))
    return F.slice(F.transform(order, lambda x: x["d"]), 1, k)


def heuristics(raw: Column, view: Column, may: Column | None = None) -> dict[str, Column]:
    """The 22 features by name; all 0 for an empty text.  may: the bits of patterns that can occur, if at hand."""
    size = F.length(raw)
    words = F.regexp_count(view, F.lit(" ")) + 1
    beyond = T.beyond_ascii(raw)
    flag = lambda c: c.cast("double")
    top = lambda c, n: F.least(c, F.lit(n)).cast("double")
    dense = F.least(count("imperative", view) * 10 / words, F.lit(3.0))
    out = {
        "log_len": F.log1p(size.cast("double")),
        "nonascii_ratio": F.when(beyond, F.length(F.regexp_replace(raw, r"[\x00-\x7F]", ""))).otherwise(F.lit(0)) / size,
        "zero_width": top(F.when(beyond, F.regexp_count(raw, F.lit(L.HIDDEN))).otherwise(F.lit(0)), 5),
        "override_instructions": top(count("override", view, may=may), 3),
        "role_tokens": top(count("role_tokens", view, may=may), 3),
        "new_policy": flag(hit("new_policy", view, may=may)),
        "jailbreak": flag(hit("jailbreak", view, may=may)),
        "exfil_verb": top(count("exfil_verb", view, may=may), 4),
        "exfil_verb_near_secret": flag(hit("exfil_verb", view, may=may) & (hit("credential", view, may=may) | hit("url", view, may=may))),
        "tool_trigger": flag(hit("tool_trigger", view, may=may)),
        "credential_ref": flag(hit("credential", view, may=may)),
        "imperative_density": dense if may is None else F.when(_can("imperative", may), dense).otherwise(F.lit(0.0)),
        "url_count": top(count("url", view, may=may), 5),
        "email_count": top(count("email", view, may=may), 5),
        "base64_blob": flag(hit("base64_blob", view, may=may)),
        "hex_blob": flag(hit("hex_blob", view, may=may)),
        "delimiter_injection": top(count("delimiter", view, may=may), 5),
        "uppercase_ratio": F.when(beyond, F.regexp_count(raw, F.lit(r"\p{IsUppercase}"))).otherwise(F.regexp_count(raw, F.lit("[A-Z]"))) / size,
        "multilingual_override": flag(hit("multilingual", view, may=may)),
        "secrecy": flag(hit("secrecy", view, may=may)),
        "coercion": flag(hit("coercion", view, may=may)),
        "malicious_payload": flag(hit("payload", view, may=may)),
    }
    return {k: F.when(size > 0, v).otherwise(F.lit(0.0)).alias(k) for k, v in out.items()}


def top_signals(features: dict[str, Column], k: int = 4) -> Column:
    """Labels of the greatest features above 0; ties by label, both descending."""
    pairs = F.array(*(F.struct(features[n].alias("v"), F.lit(label).alias("label")) for n, label in L.SIGNALS.items()))
    return F.slice(F.transform(F.sort_array(F.filter(pairs, lambda x: x["v"] > 0), asc=False), lambda x: x["label"]), 1, k)


def fuse(model: Column, rule: Column, untrusted: Column, blank: Column, model_weight: float = 1.0, nudge: float = 0.05, low: float = 0.30, high: float = 0.85) -> Column:
    """The greater of model and rule score; nearly decided untrusted texts are nudged up."""
    score = F.greatest(model * model_weight, rule)
    score = F.when(untrusted & (score >= low) & (score < high), F.least(F.lit(1.0), score + nudge)).otherwise(score)
    return F.when(blank, F.lit(0.0)).otherwise(score)
