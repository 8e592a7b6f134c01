"""Brute-force versions that the corpus operators are held against."""

import re
from collections import defaultdict

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def shingles(text):
    words = SPACED.findall((text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(texts, percent):
    """The least id that each id is connected to."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(set)
    for i, own in sets.items():
        for s in own:
            held[s].add(i)
    for i, own in sets.items():
        for j in {j for s in own for j in held[s] if j < i}:
            both = len(own & sets[j])
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def base_licenses(text):
    words = PLAIN.findall((text or "").translate(FOLD))
    runs = [(p.split(), label) for p, label in PHRASES.items()]
    return len(words), [(i, label) for run, label in runs for i in range(len(words)) if words[i : i + len(run)] == run]


def leaks(texts, items):
    """(document, item) where half of the item's runs of four words stand in the document."""

    def runs(text):
        words = PLAIN.findall((text or "").translate(FOLD))
        return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}

    sought = {k: runs(t) for k, t in items.items()}
    held = defaultdict(set)
    for k, own in sought.items():
        for run in own:
            held[run].add(k)
    found = set()
    for doc, text in texts.items():
        own = runs(text)
        for k in {k for run in own for k in held.get(run, ())}:
            if len(own & sought[k]) >= 0.5 * len(sought[k]):
                found.add((doc, k))
    return found
