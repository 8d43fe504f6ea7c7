"""Memories that a text holds, found by patterns, and how much a new text surprises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.operators.insight import core_words, negated

_END = r"(?:\.|\z)"
#: Kinds of memories in order with prefix, confidence, priority, least length and the patterns of each (English).
CAPTURE = (
    ("decision", "decision: ", 0.8, 6, 10, (r"(?:we |i )(?:decided|chose|selected|picked|opted)(?: to)?[:\s]+(.+?)" + _END, r"(?:the )?decision(?: is| was)?[:\s]+(.+?)" + _END, r"(?:switched|moved|migrated) (?:from .+? to|to) (.+?)" + _END)),
    ("error", "error: ", 0.85, 7, 10, (r"error[:\s]+(.+?)" + _END, r"failed[:\s]+(.+?)" + _END, r"bug[:\s]+(.+?)" + _END, r"(?:the )?issue (?:is|was)[:\s]+(.+?)" + _END, r"problem[:\s]+(.+?)" + _END, r"(?:fixed|resolved|solved)(?: (?:it|this))? by[:\s]+(.+?)" + _END)),
    ("todo", "todo: ", 0.75, 5, 5, (r"(?:todo|fixme|hack|xxx)[:\s]+(.+?)" + _END, r"(?:remember to|don't forget to)[:\s]+(.+?)" + _END)),
    ("fact", "", 0.7, 5, 15, (r"(?:the |a )?(?:answer|solution|fix) (?:is|was)[:\s]+(.+?)" + _END, r"(?:it |this )(?:works|worked) because[:\s]+(.+?)" + _END, r"(?:learned|discovered|found out)[:\s]+(.+?)" + _END)),
    ("insight", "insight: ", 0.8, 6, 15, (r"turns out[:\s]+(.+?)" + _END, r"the trick (?:is|was)[:\s]+(.+?)" + _END, r"(?:the )?root cause (?:is|was)[:\s]+(.+?)" + _END, r"(?:lesson learned|takeaway|key insight)[:\s]+(.+?)" + _END)),
    ("preference", "preference: ", 0.85, 7, 10, (r"(?:i |we )(?:prefer|like|want|favor)[:\s]+(.+?)" + _END, r"(?:i |we )(?:don't like|dislike|hate|avoid)[:\s]+(.+?)" + _END, r"(?:always|never) (?:use|do|include|add|write)[:\s]+(.+?)" + _END)),
)


def memories(text: Column) -> Column:
    """array of struct(type, content, confidence, priority): what the patterns capture, in lower case, each content once. Very long captures and very short ones count for less, and long ones end at a sentence."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), []
    for kind, prefix, confidence, priority, least, patterns in CAPTURE:
        hits = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in patterns]))
        hits = F.filter(F.transform(hits, lambda x: F.trim(x)), _long(least))
        out.append(F.transform(hits, _memory(kind, prefix, confidence, priority)))
    every = F.flatten(F.array(*out))
    return F.filter(every, lambda x, i: ~F.exists(F.slice(every, 1, i), lambda y: (y["content"] == x["content"]) & (y["type"] == x["type"])))


def _long(least: int):
    return lambda x: F.length(x) >= least


def _memory(kind: str, prefix: str, confidence: float, priority: int):
    def make(x: Column) -> Column:
        sure = F.when(F.length(x) > 200, confidence * 0.7).when(F.length(x) < 10, confidence * 0.3).otherwise(confidence)
        cut = x
        for mark in ";?!":  # the first of ! ? ; that has a mark decides
            head = F.regexp_extract(x, f"^(.{{50,}}?)[{mark}]", 1)
            cut = F.when(head != "", head).otherwise(cut)
        return F.struct(F.lit(kind).alias("type"), F.concat(F.lit(prefix), F.when(F.length(x) > 100, cut).otherwise(x)).alias("content"), F.round(sure, 4).alias("confidence"), F.lit(priority).alias("priority"))

    return make


#: Words that say the opposite of each other.
OPPOSITES = (("fast", "slow"), ("good", "bad"), ("works", "broken"), ("stable", "unstable"), ("safe", "unsafe"), ("easy", "hard"), ("simple", "complex"), ("reliable", "unreliable"), ("efficient", "inefficient"), ("success", "failure"))


def reversal(a: Column, b: Column) -> Column:
    """Whether one text denies what the other says, or says the opposite."""
    flip = (negated(a) != negated(b)) & (F.size(F.array_intersect(core_words(a), core_words(b))) >= 2)
    has = lambda text, word: F.lower(text).rlike(f"(?:^|[^a-z0-9_]){word}(?:[^a-z0-9_]|$)")
    for x, y in OPPOSITES:
        flip = flip | (has(a, x) & has(b, y)) | (has(a, y) & has(b, x))
    return flip


def surprise(reversed_: Column, nearest: Column) -> Column:
    """0 to 2.5: 1.5 without anything to compare with, 2.5 for a reversal, else by the bits from the nearest text."""
    return F.when(nearest.isNull(), 1.5).when(reversed_, 2.5).when(nearest < 5, 0.0).when(nearest < 15, (nearest - 5) / 10).when(nearest < 30, 1 + (nearest - 15) / 15).otherwise(2.0)
