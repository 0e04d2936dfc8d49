"""Scores and tests of domain names beyond those of single labels: bigram model, keyword lists, the prefilter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fields as fn

#: Characters of the bigram model, its least scored length, and the score from which a name counts as generated.
ALPHABET, LEAST, GENERATED = "abcdefghijklmnopqrstuvwxyz0123456789-", 4, 0.70
#: Suffixes and words of the suspicion tests.
CHEAP_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".xyz", ".click", ".link"]
MINING_WORDS = ["xmrig", "minexmr", "supportxmr", "nanopool", "stratum", "hashvault", "moneroocean"]
DYNAMIC_WORDS = ["ddns", "dyndns", "no-ip", "duckdns"]
DYNAMIC_SUFFIXES = [".hopto.org", ".zapto.org", ".sytes.net", ".ddns.net"]
MINER_WORDS = ["miner", "xmr"]


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def second_level(qname: Column) -> Column:
    """The label before the last one, in lower case; a name of one label is that label."""
    labels = F.split(F.lower(F.regexp_replace(qname, r"\.\z", "")), r"\.")
    return F.when(F.size(labels) < 2, F.get(labels, F.lit(0))).otherwise(F.get(labels, F.size(labels) - 2))


def consonant_ratio(s: Column) -> Column:
    """Consonants a vowel; the consonants themselves without a vowel."""
    letters = F.regexp_replace(F.lower(s), r"\P{L}", "")
    vowels = F.char_length(F.regexp_replace(letters, "[^aeiou]", ""))
    consonants = F.char_length(letters) - vowels
    return F.when(vowels == 0, consonants.cast("double")).otherwise(consonants / vowels)


def bigram_model(words: DataFrame, column: str = "word") -> dict[str, float]:
    """ln P(second | first) of every pair of the alphabet, with one count more each, from a table of words."""
    word = F.lower(F.col(column))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word) - 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(2)))).alias("pair"))
    found = pairs.where(F.col("pair").rlike(f"^[{ALPHABET[:-1]}-]{{2}}\\z")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.pair: r.n for r in found.collect()}  # at most 37 * 37 rows
    import math

    rows = {a: sum(counts.get(a + b, 0) + 1 for b in ALPHABET) for a in ALPHABET}
    return {a + b: math.log((counts.get(a + b, 0) + 1) / rows[a]) for a in ALPHABET for b in ALPHABET}


def bigram_score(qname: Column, model: dict[str, float]) -> Column:
    """Near 1 for a second-level name of rare bigrams, near 0 for common ones; 0 for short names."""
    name = second_level(qname)
    table = F.create_map(*[x for k, v in model.items() for x in (F.lit(k), F.lit(v))])
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(name) - 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(2)))
    known = F.filter(F.transform(pairs, lambda p: F.try_element_at(table, p)), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.when((F.octet_length(name) < LEAST) | (F.size(known) == 0), F.lit(0.0)).otherwise(1 / (1 + F.exp(mean + 3.5)))


def is_generated(qname: Column, model: dict[str, float]) -> Column:
    """By entropy or by bigrams."""
    return fn.is_generated(qname) | (bigram_score(qname, model) >= GENERATED)


def is_mining_name(qname: Column) -> Column:
    q = F.lower(qname)
    return any_of([q.contains(w) for w in MINING_WORDS]) | (q.contains("pool") & q.contains("mine"))


def is_dynamic_name(qname: Column) -> Column:
    q = F.lower(qname)
    return any_of([q.contains(w) for w in DYNAMIC_WORDS] + [q.endswith(x) for x in DYNAMIC_SUFFIXES])


#: Names of mining programs.
MINER_NAMES = ("xmrig", "minerd", "cgminer", "bfgminer")


def is_miner(comm: Column) -> Column:
    c = F.lower(comm)
    return c.isin(*MINER_NAMES) | any_of([c.contains(w) for w in MINER_WORDS])


def is_suspicious(qname: Column, qtype: Column, rcode: Column, is_response: Column, comm: Column, score: Column, threshold: float = GENERATED) -> Column:
    """Whether a DNS event deserves the costly policies: TXT, a negative answer, a long, generated, mining, exit-node or dynamic name, a miner's query."""
    q = F.lower(qname)
    tests = [
        qtype == 16, is_response & (rcode == 3), fn.is_tunneling(qname), is_miner(comm), fn.is_generated(qname), score > threshold, fn.has_odd_tld(qname), any_of([q.endswith(t) for t in CHEAP_TLDS]),
        is_mining_name(qname), q.contains("tor") & q.contains("exit"), is_dynamic_name(qname),
    ]
    return any_of([F.coalesce(t, F.lit(False)) for t in tests])
