"""Helpers the tests of this folder share."""

import re


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))
