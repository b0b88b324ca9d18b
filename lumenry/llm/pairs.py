"""Broken prompt and response pairs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.languages import STOPWORDS, english_rows, is_foreign
from lumenry.llm.truncation import judged_rows
from lumenry.llm.words import tokenised

SPAN = 2  # words of a copied span
COPIED_PROMPT, COPIED_RESPONSE = 0.7, 0.55
TOLD = 0.25  # of the prompt's content words: a response with more of them tells of the scene

# Texts that only stand for nothing, letters and digits only.
NOTHING = frozenset(("", "blank", "empty", "na", "nan", "nil", "nocaption", "nooutput", "none", "noresponse", "null", "pad", "undefined"))

# A grammar of refusals over words without apostrophes: an apology, who refuses, a refusing verb, a task, what was asked for.
_SORRY = r"(?:(?:(?:i am|im|we are|were|my) )?(?:(?:so|very|really|terribly|truly|deeply) )?(?:sorry|apologies|afraid)(?: about that| for that| for the inconvenience)?(?: but| that)?|(?:i|we) (?:apologize|apologise|regret)(?: but| that)?|unfortunately|regrettably|sadly)"
_WHO = r"(?:i am|we are|im|ill|id|ive|i|we)"
_NOT = (
    r"(?:cannot|can not|cant|could not|couldnt|will not|wont|would not|wouldnt|would rather not|rather not|prefer not to|may not|must not|do not|dont|"
    r"(?:not able|unable|not willing|unwilling|not allowed|not permitted|not comfortable|not going|not in a position|not prepared|refuse|decline)(?: to)?|"
    r"(?:must|have to|need to|will have to|am going to|would like to|choose to|going to have to) (?:decline|refuse|pass)(?: to)?)"
)
_TASK = (
    r"(?:assist|help|comply|fulfill|fulfil|rewrite|rewriting|rephrase|restyle|edit|write|writing|create|creating|generate|generating|produce|producing|provide|providing|complete|"
    r"process|do|doing|make|turn|change|give|offer|caption|describe|answer|respond|reply|proceed|continue|engage|support|handle|satisfy|honor|honour|accommodate|see|view|access|open)"
)
_ASKED = r"(?:captions?|requests?|prompts?|rewrites?|rewriting|tasks?|descriptions?|responses?|instructions?)"
_DONE = r"(?:completed|fulfilled|rewritten|processed|written|created|generated|produced|provided|answered|handled|honou?red|done|made|returned|shown)"
_ADVERB = r"(?:simply|really|just|also|unfortunately|respectfully|politely|currently|sadly|honestly)"
#: What is a refusal whatever else is said.
_REFUSES = re.compile(
    rf"(?:\b{_WHO}|^{_SORRY}|^)(?: ?\b{_ADVERB})? ?\b{_NOT} {_TASK}(?: \w+){{0,4}} {_ASKED}\b"
    rf"|^(?:{_SORRY} )?(?:{_WHO} )?(?:{_ADVERB} )?{_NOT} {_TASK}(?: with| on)?(?: (?:this|that|it))(?: one)?"
    rf"(?: for you| today| right now| im sorry| i am sorry| im afraid| sorry)*$"
    rf"|\b(?:this|that|the|your) {_ASKED} (?:cannot|can not|cant|could not|couldnt|will not|wont) be {_DONE}\b"
    r"|\bas (?:an?|your) (?:ai|artificial intelligence|language model|large language model|text based model|virtual assistant)\b|\b(?:large )?language model\b|\bai (?:assistant|model|system)\b"
    r"|\b(?:violat\w+|against|conflicts? with|outside|breach\w*|break\w*|contrary to|not (?:allowed|permitted) (?:by|under)|restricted by|comply with|prevent\w*|prohibit\w*|forbid\w*)(?: \w+){0,3} (?:guidelines?|polic(?:y|ies)|terms|programming|rules)\b"
    r"|\b(?:guidelines?|polic(?:y|ies)|programming)(?: \w+){0,2} (?:prevents?|prohibits?|forbids?|do not allow|does not allow|dont allow|doesnt allow|do not permit|dont permit)\b"
)
# Tasks of whoever answers; people in scenes have other ones.
_OFFICE = (
    r"(?:assist|help (?:you|with)|comply|fulfill|fulfil|rewrite|rewriting|rephrase|restyle|edit|generate|generating|create|creating|produce|producing|provide|providing|complete|process|proceed|respond|"
    r"answer|support|accommodate|describe|caption|writ(?:e|ing) (?:about|that|this|it|such)|do (?:that|this|it)|see (?:the|this|that|any) (?:image|photo|picture)|"
    r"(?:change|alter|adjust|modify|make|turn|put|give)(?: \w+){0,4} (?:texts?|captions?|sentences?|lines?|tone|style|descriptions?|wording))"
)
#: What is a refusal if the response doesn't tell of the prompt's scene.
_MAY_REFUSE = re.compile(
    rf"\b{_WHO}(?: \w+){{0,2}} {_NOT}(?: \w+){{0,3}} {_OFFICE}\b"
    rf"|\b(?:i|id|i would|we) (?:much )?(?:rather|prefer)(?: to)? not\b|\b{_WHO}(?: \w+){{0,3}} (?:decline|refuse)\b|\b(?:have|need|going|like) to (?:pass|decline|refuse)\b"
    rf"|^{_SORRY}(?: \w+){{0,3}} {_NOT}\b"
    r"|\b(?:please|could you|can you|would you|kindly|try|feel free to|you may|you can)(?: \w+){0,3} (?:provide|share|send|upload|give|supply|submit|attach|choose|pick|ask|enter|resubmit|try|rephrase|clarify|specify)"
    r"(?: \w+){0,4} (?:captions?|images?|photos?|pictures?|texts?|prompts?|context|details?|information|one|requests?|again|else|something|input)\b"
    r"|\b(?:not|no|without|lack\w*|insufficient|too little|more)(?: \w+){0,3} (?:context|information|details?|access|ability|permission)\b(?: \w+){0,3} (?:to|for|of|about)\b"
    r"|\b(?:dont|do not|cannot|cant|unable to|not able to)(?: \w+){0,2} (?:have|see|view|access|open|feel comfortable)\b(?: \w+){0,3} (?:image|photo|picture|caption|context|information|ability|this|that)\b"
    rf"|\b(?:this|that|it|such|the|your)(?: \w+){{0,3}} (?:is|are|was|would be|falls?|seems?|appears?|goes|lies)(?: \w+){{0,2}} (?:not appropriate|inappropriate|not something|outside|beyond|not allowed|not permitted|not possible|unsuitable|harmful|offensive|sensitive)\b"
    rf"|\bno (?:\w+ )?(?:captions?|rewrites?|versions?|responses?|answers?|outputs?|results?)(?: \w+){{0,2}} (?:is|was|were|are|can|could|will|has)\b"
    rf"|\b(?:captions?|rewrites?|versions?|requests?|tasks?|response|content)(?: \w+){{0,3}} (?:cannot|can not|cant|could not|couldnt|wont|will not|not|declined|denied|refused|rejected|blocked)\b"
    rf"|\b(?:cannot|can not|cant|could not|couldnt|wont|will not|not)(?: \w+){{0,2}} be {_DONE}\b"
    r"|\b(?:would|is|may|might|will)(?: not|nt) be (?:appropriate|suitable|right|possible|safe|okay|ok|proper|wise)(?: for (?:me|us))?\b|\b(?:isnt|is not|not) (?:appropriate|suitable|possible) for (?:me|us)\b"
    r"|\b(?:let me know|happy to help|glad to help|here to help|help you with (?:something|anything)|anything else|(?:another|different|new) (?:captions?|requests?|prompts?|images?|photos?))\b"
    r"|\b(?:pass|skip)(?: on)? (?:this|that|it|one)\b|\bnot (?:something|a thing|one) (?:i|we)\b|\b(?:outside|beyond)(?: \w+){0,2} (?:scope|abilities|capabilities|ability|capability|remit)\b"
)
#: Words without one of which, or a denying one and one of whoever answers, no refusal is looked for.
_DENYING, _SELF = frozenset("not don't dont rather".split()), frozenset("i i'm im i'd id i'll ill we me my".split())
_REFUSING = frozenset(
    "cannot can't cant couldn't couldnt won't wont wouldn't wouldnt unable unwilling refuse refused decline declined sorry apologies apologize apologise regret unfortunately regrettably "
    "comply assist guideline guidelines policy policies programming ai model inappropriate appropriate request requests caption captions prompt rewrite rewriting rephrase "
    "comfortable permitted version versions provided upload clarify context scope capabilities pass skip".split()
)
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}
_CLOSERS = set(_PAIRS.values())
_OPENERS = "[" + re.escape("".join(_PAIRS)) + "]"
_ENDS = frozenset(".!?\"”’')]}»")
_SMALL = frozenset(STOPWORDS["en"].split())


def is_refusal(words: list[str], prompt: list[str]) -> bool:
    """Whether a response declines its task: by a phrase of the grammar that only refusals have, or by one that scenes
    may have too where hardly any content word of the prompt is told again."""
    plain = " ".join(words).replace("'", "")
    if _REFUSES.search(plain):
        return True
    if not _MAY_REFUSE.search(plain):
        return False
    content = {w for w in prompt if len(w) > 2 and w not in _SMALL and w not in _REFUSING}
    return len(content.intersection(words)) <= TOLD * len(content)


class SuffixAutomaton:
    """All runs of words of a prompt."""

    def __init__(self, words: tuple[str, ...]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for word in words:
            here = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = here
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                if self.length[q] == self.length[p] + 1:
                    self.link[here] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(word) == q:
                        self.next[p][word] = twin
                        p = self.link[p]
                    self.link[q] = self.link[here] = twin
            last = here

    def covered(self, words: list[str], least: int = SPAN) -> int:
        """Words of a response that lie in a run of at least ``least`` words of the prompt."""
        state = run = covered = upto = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if word in self.next[state]:
                state, run = self.next[state][word], run + 1
            else:
                run = 0
            if run >= least:
                begin = max(upto, i - run + 1)
                covered += i + 1 - begin
                upto = i + 1
        return covered


@lru_cache(maxsize=4096)
def _automaton(words: tuple[str, ...]) -> SuffixAutomaton:
    return SuffixAutomaton(words)


def is_copy(prompt: list[str] | None, response: list[str]) -> bool:
    """Whether a response is its prompt again: runs of it cover most of both."""
    if not prompt or not response:
        return False
    if prompt == response:
        return True
    covered = _automaton(tuple(prompt)).covered(response)
    return covered >= COPIED_PROMPT * len(prompt) and covered >= COPIED_RESPONSE * len(response)


def is_nothing(text: str | None) -> bool:
    if text is None:
        return True
    if len(text) > 40:
        return not any(c.isalnum() for c in text)
    plain = "".join(c for c in unicodedata.normalize("NFKC", text.replace("\\n", "").replace("\\t", "")).lower() if c.isalnum())
    return plain in NOTHING


def unclosed(text: str) -> bool:
    """Whether a bracket or quotation mark is left open at the end, by a stack of them."""
    stack: list[str] = []
    for c in text:
        if c in _PAIRS:
            stack.append(_PAIRS[c])
        elif c in _CLOSERS and stack and stack[-1] == c:
            stack.pop()
    return bool(stack)


DEFECTS = ("empty", "refusal", "copy", "language", "truncated")


class _Defects:
    """The defects of a batch of responses, by whole columns; what may have one is looked at by itself."""

    def __call__(self, said: pa.Array, asked: pa.Array, words: pa.ListArray) -> np.ndarray:
        n = len(said)
        out = np.full(n, None, dtype=object)
        count = np.diff(words.offsets.to_numpy())
        row = np.repeat(np.arange(n), count)
        prompts = tokenised(asked)
        asked_count = np.diff(prompts.offsets.to_numpy())
        both = pa.concat_arrays([words.flatten(), prompts.flatten()]).dictionary_encode()
        vocabulary = both.dictionary.to_pylist()
        codes = both.indices.to_numpy(zero_copy_only=False)
        codes, asked_codes = codes[: len(row)], codes[len(row) :]
        is_null = said.is_null().to_numpy(zero_copy_only=False)
        doubtful = is_null | (count == 0) | (pc.utf8_length(pc.fill_null(said, "")).to_numpy(zero_copy_only=False) <= 40)
        some = np.flatnonzero(doubtful)
        for i, text in zip(some, said.take(pa.array(some)).to_pylist()):
            if is_nothing(text):
                out[i] = "empty"

        def left(mask: np.ndarray, *columns: pa.Array) -> Iterator[tuple]:
            """The rows of ``mask`` without a defect so far, with their values."""
            at = np.flatnonzero(mask & (out == None))  # noqa: E711
            return zip(at, *(c.take(pa.array(at)).to_pylist() for c in columns))

        def some_of(wanted: frozenset[str]) -> np.ndarray:
            flags = np.fromiter((w in wanted for w in vocabulary), bool, len(vocabulary))
            return np.bincount(row, weights=flags[codes], minlength=n) > 0

        for i, own, prompt in left(some_of(_REFUSING) | some_of(_DENYING) & some_of(_SELF), words, prompts):
            if is_refusal(own, prompt):
                out[i] = "refusal"
        # What runs of the prompt cover is no more than the words it knows.
        known = _shared(asked_codes, np.repeat(np.arange(n), asked_count), codes, row, n)
        for i, own, prompt in left((asked_count > 0) & (known >= COPIED_PROMPT * asked_count) & (known >= COPIED_RESPONSE * count), words, prompts):
            if is_copy(prompt, own):
                out[i] = "copy"
        for i, text in left(~english_rows(vocabulary, codes, row, count), said):
            if is_foreign(text):
                out[i] = "language"
        for i, text in left(pc.match_substring_regex(pc.fill_null(said, ""), _OPENERS).to_numpy(zero_copy_only=False).astype(bool), said):
            if text.rstrip()[-1:] not in _ENDS and unclosed(text):
                out[i] = "truncated"
        return out


def _shared(asked_codes: np.ndarray, asked_row: np.ndarray, codes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """An upper bound of each response's words that its prompt has, by a table of marks of (row, word)."""
    size = np.uint64(64 - max(10, 4 + int(len(asked_codes)).bit_length()))

    def place(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((r.astype(np.uint64) << np.uint64(32) | c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> size).astype(np.int64)

    table = np.zeros(1 << int(np.uint64(64) - size), dtype=bool)
    table[place(asked_row, asked_codes)] = True
    return np.bincount(row, weights=table[place(row, codes)], minlength=n)


def broken_pairs(rows: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """``(key, defect)`` of the rows with a defective response, one defect each.

    In this order: ``empty`` (null, blank, or a token for nothing); ``refusal``
    (by the automaton of a grammar of refusals, part of which counts only where
    the prompt's scene isn't told); ``copy`` (a suffix automaton of the
    prompt's words shows that runs of them cover the prompt and most of the
    response); ``language`` (votes of the stopwords of 38 languages, or other
    letters); ``truncated`` (as ``truncated_rows``, or with a bracket left
    open). A null prompt is not copied. Repeated rows are judged alike. All
    but truncation is judged in the pass that looks for open ends.
    """
    judged = judged_rows(rows, key, response, prompt, _Defects).select("row_id", F.coalesce("defect", F.lit("truncated")).alias("defect"))
    order = {name: i for i, name in enumerate(DEFECTS)}
    rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    # Rows repeated under one key may have several; the first of the order counts.
    return judged.groupBy("row_id").agg(F.min(rank[F.col("defect")]).alias("rank")).select(
        F.col("row_id").alias(key), F.element_at(F.lit(list(DEFECTS)), F.col("rank") + 1).alias("defect")
    )
