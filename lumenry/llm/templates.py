"""Template residue, filler and error pages by mining message templates."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.languages import STOPWORDS
from lumenry.stage import stage

DEPTH = 3  # tokens that choose the way through the tree, after the length
SIMILARITY = 0.6
ANY, CODE, NUMBER, NAME = "<*>", "<code>", "<#>", "<id>"
TOLD_FILLERS, TOLD_SHARE, TOLD_TOKENS = 4, 0.15, 8  # different words in one place of a template, their share of its messages, and its tokens, that tell a sentence from a message
RECURRING = 3  # documents that must have a message in which only weak cues stand
FILLERS = 64  # different words of one place that are told apart

# Reasons of HTTP replies.
REASONS = (
    "access denied", "authorization required", "bad gateway", "bad request", "conflict", "forbidden", "gateway timeout", "gone", "internal server error",
    "method not allowed", "not acceptable", "not found", "not implemented", "page not found", "payload too large", "payment required", "request timeout",
    "service unavailable", "too many requests", "unauthorized", "unavailable for legal reasons",
)
# The passages of Cicero that dummy text is made of, and its usual wording.
DUMMY = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum sed perspiciatis unde omnis iste natus error "
    "voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo "
    "nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam eius "
    "modi tempora incidunt magnam quaerat minima nostrum ullam corporis suscipit laboriosam commodi consequatur vel eum iure quam nihil molestiae illum fugiat "
    "vero accusamus iusto odio dignissimos ducimus blanditiis praesentium voluptatum deleniti atque corrupti quos quas molestias excepturi occaecati cupiditate "
    "provident similique mollitia animi laborum dolorum fuga harum quidem rerum facilis expedita distinctio nam libero tempore soluta nobis eligendi optio cumque "
    "impedit minus quod maxime placeat facere possimus assumenda repellendus temporibus quibusdam officiis debitis necessitatibus saepe eveniet repudiandae "
    "recusandae itaque earum hic tenetur sapiente delectus reiciendis voluptatibus maiores alias perferendis doloribus asperiores repellat"
).split()
_STEMS = frozenset(w[:4] for w in DUMMY if len(w) >= 4)
_SHORT = frozenset(w for w in DUMMY if len(w) < 4)
_ENGLISH = frozenset(w for w in STOPWORDS["en"].split()) - {"in", "do"}

# What stands in a message: things that fail, and how. These patterns are of the kind that matches in linear time, as they go over all text.
_THING = (
    r"(?:pages?|sites?|websites?|files?|documents?|resources?|urls?|links?|address|images?|photos?|pictures?|albums?|galler(?:y|ies)|videos?|contents?|items?|posts?|articles?|"
    r"accounts?|services?|servers?|hosts?|databases?|connections?|requests?|applications?|apps?|modules?|systems?|networks?)"
)
_REASON = "(?:" + "|".join(REASONS) + ")"
_UNABLE = r"(?:cannot|can't|can not|could not|couldn't|unable to|failed to|failure to|not able to|isn't able to)"
_ADVERB = r"(?:currently |temporarily |permanently |presently |right now |at the moment )?"
_ERROR = "|".join((
    rf"<code>\W{{0,4}}{_REASON}\b", rf"\b{_REASON}\s*\(?<code>", r"\b(?:http|error|status|code)\W{0,3}<code>",
    rf"\b{_THING}\b.*\b(?:not found|no longer (?:available|exists?|online)|isn't (?:available|working|responding)|(?:is|are|was|were) not (?:available|loaded|found|responding)|{_ADVERB}unavailable|"
    r"(?:cannot|can't|could not|couldn't|can not) be (?:found|located|reached|displayed|loaded|opened|processed|completed)|(?:does not|doesn't|do not|don't) exist|"
    r"timed out|has expired|refused to connect|failed to load|took too long)\b",
    rf"\b{_UNABLE} (?:find|locate|load|reach|open|connect to|display|access|handle|process|complete|retrieve|fetch|resolve)\b.*\b{_THING}\b",
    r"\b(?:connection|request|query|login|upload|download|database) (?:\w+ )?(?:failed|timed out|refused|aborted)\b", r"\bcould not reach\b", r"\bdid not (?:answer|respond|reply)\b.*\btime\b",
    r"\b(?:need|don't have|do not have|lack|without|requires?|no)\b.*\bpermissions?\b.*\b(?:view|access|see|open|page|resource|content)\b", r"\baccess (?:is |was |has been )?denied\b",
    r"\byou (?:are|have been|were) (?:not authori[sz]ed|blocked|banned|logged out|signed out|not allowed to (?:view|access))\b", r"\bunauthori[sz]ed access\b",
    r"\baccess to\b.*\b(?:is |was )(?:forbidden|denied|restricted|not allowed)\b", r"\berror (?:establishing|loading|connecting|processing|retrieving|opening|reading|while)\b",
    r"\bnot available in your (?:region|country|area)\b", r"\b(?:something|things) went wrong\b", r"\b(?:error|problem|exception) (?:has |have )?(?:occurred|was encountered)\b",
    r"\b(?:try|come) (?:again|back)\b.*\b(?:later|soon|moments?|minutes?)\b", r"\bsession (?:has |have )?(?:expired|timed out|ended)\b", r"\b(?:under|down for|scheduled|undergoing) maintenance\b",
    r"\w(?:exception|error):", r"\btraceback \(most recent", r"\bsegmentation fault\b", r"\bnull ?pointer\b", r"\b(?:uncaught|unhandled) (?:exception|error|promise)\b", r"\bstack ?overflow (?:at|in)\b",
    r"\bfatal error\b", r"\bcore dumped\b", r"\btoo many (?:requests|redirects|connections)\b", r"\b(?:rate limit|quota) exceeded\b", r"\bnotified\b.*\b(?:request|incident|reference|error|code)\b",
    r"(?:seite|bild|datei|page|image|photo|fichier|página|pagina|imagen|imagem|archivo|immagine|sida|siden|bilden|strona|sayfa|afbeelding)\b.*(?:nicht gefunden|nicht verfügbar|introuvable|"
    r"n'est (?:plus|pas) disponible|n'existe (?:pas|plus)|no encontrad[ao]|no (?:está )?disponible|no existe|não (?:foi )?encontrad[ao]|não (?:está )?disponível|non trovat[ao]|non (?:è )?disponibile|"
    r"niet gevonden|niet beschikbaar|hittades inte|ikke fun[dn]et|nie znaleziono|bulunamadı|wurde (?:verschoben|gelöscht|entfernt)|a été (?:supprimée?|déplacée?)|ha sido (?:eliminad|movid)[ao]|foi (?:removid|movid)[ao])",
))
_SCRIPTS = r"(?:javascript|java script|scripts?|scripting|active content)"
_NEEDED = (
    r"(?:enabled?|enabling|activat\w+|active|activez|activer|activar|aktivieren|aktiviere|habilit\w+|abilita\w*|inschakelen|turn(?:ed)?|switch(?:ed)?|allow(?:ed)?|permit(?:ted)?|required|requires?|needed|needs|"
    r"necessary|must|disabled?|blocked|blocks?|missing|unsupported|support|supported|runs?|without|off)"
)
_SCRIPT = rf"\b{_NEEDED}\b.*\b{_SCRIPTS}\b|\b{_SCRIPTS}\b.*\b{_NEEDED}\b|\bnoscript\b"
_PART = r"(?:text|title|caption|heading|headline|subtitle|content|description|copy|name|paragraph|quote|image|photo|picture|link)s?"
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "yxcvbnm", "azertyuiop")
_KEYS = "|".join(dict.fromkeys(row[i : i + 4] for row in _ROWS for i in range(len(row) - 3)))
_STOPGAP = "|".join((
    rf"\b{_PART} (?:goes?|will go|comes?|belongs?) here\b", rf"\byour {_PART} here\b", rf"\b(?:insert|add|type|put|enter|write|place)(?: (?:your|some|the|a|an))?(?: \w+)? {_PART} here\b", r"\bblah,? blah\b", r"\byada,? yada\b",
    rf"\b(?:{_KEYS})\w*\b", r"\bfoo,? bar\b", rf"^\W*(?:sample|dummy|placeholder|filler|example|test) {_PART}\b", rf"\b(?:sample|dummy|filler) {_PART}\W*$",
))
_DUMMY_CUE = r"\b(?:" + "|".join(sorted(_STEMS)) + r")\w*\b"
# Weak cues: a message only if it recurs word for word.
_WEAK = "|".join((
    rf"\b{_THING}\b.*\b(?:removed|moved|deleted|renamed|blocked|disabled|offline|down|lost|missing|broken|corrupt(?:ed)?|vanished|gone|away|off)\b", r"\b(?:removed|moved|deleted|renamed)\b.*\bowner\b",
    r"\b(?:incomplete|invalid|unexpected|malformed|empty) (?:reply|response|request|answer|data)\b", rf"\b{_THING}\b.*\b(?:looking|asked|searched|requested)\b", r"\b(?:reload|refresh)\b", r"\bsorry\b.*\bpage\b",
))
_BARE = re.compile(rf"\W*(?:(?:http|error)\W*)?{_REASON}\W*")
_PATTERNS = {"error": re.compile(_ERROR), "script": re.compile(_SCRIPT), "filler": re.compile(_STOPGAP)}
_WEAKLY = re.compile(_WEAK)
# Over raw text, where numbers aren't masked yet.
_CUES = "(?i)" + "|".join((_ERROR.replace("<code>", r"\b[45]\d\d\b"), _SCRIPT, _STOPGAP, _WEAK, rf"^\W*(?:(?:http|error)\W*)?{_REASON}\W*$"))
# Words by which a sentence tells of such things: reports, and what they are found on. They count where too few documents have the sentence to show what varies in it.
_REPORTS = re.compile(
    r"\b(?:told|tells?|said|says|explain\w*|learn\w*|asks?|asked|talk\w*|jok\w+|laugh\w*|remember\w*|recall\w*|wrote|writes|describ\w+|posters?|paintings?|signs?(?! (?:in|up|on|off|out))|"
    r"lessons?|chapters?|novels?|comics?|cartoons?|story|stories|this (?:year|week|month)|last (?:year|week|month)|he|she|they|his|her|him|their)\b"
)

_SLOT = re.compile(
    r"\{\{[^{}]{0,60}\}\}|\$\{\s*\w+\s*\}|(?<![\w$])\{\s*\w{1,40}\s*\}|%\(\w+\)s|(?<![\w%])%[sd]\b|\[\[\s*\w[\w ]{0,40}\]\]"
    r"|\[\s*(?:insert|your|add|enter|name|placeholder|caption|title|image|photo|text|date|city|address|company|product|link|author|subject|describe)\b[^\[\]]{0,60}\]|<%[^%]{0,60}%>|<[a-z]+(?:_[a-z]+)+>"
    r"|#[a-z]+(?:_[a-z]+)*#|%%[a-z_]+%%|__[a-z]+(?:_[a-z]+)*__|(?<!\w)x{4,}(?!\w)|\btodo:|\btbd\b|(?<!\w)undefined(?!\w)",
    re.I,
)
_SLOT_CUE = r"(?i)\{\{|\$\{|\{\s*\w+\s*\}|%\(|%[sd]\b|\[|<%|<\w+_|#\w+#|%%|__|xxxx|todo:|\btbd\b|undefined"
# A sentence that speaks of slots by name has none.
_SLOT_TOLD = re.compile(r"\b(?:slots?|placeholders?|braces|brackets?|written as|stands? for|syntax|in (?:our|the|this) template)\b", re.I)
_BREAK = r"([.!?])\s+"
_TOKEN_ID = re.compile(r"\w[._/@=:\\-]+\w*[._/@=:\\]\w|\w[/@=\\]\w|[a-z]\.[a-z]|_")
_WORD = re.compile(r"[a-z']+")
_TAG = re.compile(r"</?(?!noscript)[a-z][a-z0-9]*>")


def has_slot(unit: str) -> bool:
    """Whether a placeholder stands in ``unit`` where a value should; a sentence about placeholders has none."""
    return _SLOT.search(unit) is not None and _SLOT_TOLD.search(unit) is None


def repeats(text: str) -> bool:
    """Whether a word stands three times in a row."""
    words = text.lower().split()
    return any(a == b == c and len(a) > 2 and a.isalpha() for a, b, c in zip(words, words[1:], words[2:]))


def is_dummy(unit: str) -> bool:
    """Whether a unit is dummy text: most words, or five in a row, begin as those of the usual passages, and few are English."""
    words = _WORD.findall(unit.lower())
    if not words:
        return False
    dummy = [len(w) >= 4 and w[:4] in _STEMS or w in _SHORT for w in words]
    long = sum(d and len(w) >= 4 for d, w in zip(dummy, words))
    english = sum(w in _ENGLISH for w in words)
    if long >= 2 and sum(dummy) >= 0.5 * len(words) and english * 8 <= len(words):
        return True
    run = most = 0
    for d in dummy:
        run = run + 1 if d else 0
        most = max(most, run)
    return most >= 5 and long >= 3 or "lorem ipsum" in unit.lower()


def tokens(unit: str) -> list[str]:
    """Tokens of a message in lower case, without tags and closing points: status codes, other numbers, and names of things are masked."""
    out = []
    for w in _TAG.sub(" ", unit.lower().replace("’", "'").replace("â€™", "'")).rstrip(" .!?").split():
        if any(c.isdigit() for c in w):
            w = CODE if re.fullmatch(r"\W*[45]\d\d\W*", w) else NUMBER
        elif _TOKEN_ID.search(w) and not w.endswith(":"):
            w = NAME
        out.append(w)
    return out


def leaf_of(toks: list[str]) -> str:
    """The way through the tree: the number of tokens and the first ``DEPTH``."""
    return f"{len(toks)} {' '.join(toks[:DEPTH])}"


class Leaf:
    """The templates of one leaf of a fixed-depth prefix tree.

    A message joins the most similar template of at least ``SIMILARITY`` equal
    tokens, the first of equal ones, and the tokens that differ become wild;
    the words that stood there are kept, up to ``FILLERS`` of a place.
    """

    def __init__(self):
        self.templates: list[list[str]] = []
        self.messages: list[int] = []
        self.documents: list[int] = []
        self.fillers: list[dict[int, set[str]]] = []

    def add(self, toks: list[str], documents: int) -> int:
        best, most = -1, SIMILARITY * len(toks)
        for at, template in enumerate(self.templates):
            same = sum(map(str.__eq__, template, toks)) + template.count(ANY)
            if same >= most and (best < 0 or same > most):
                best, most = at, same
        if best < 0:
            self.templates.append(list(toks))
            self.messages.append(0)
            self.documents.append(0)
            self.fillers.append({})
            best = len(self.templates) - 1
        template, fillers = self.templates[best], self.fillers[best]
        for i, (a, b) in enumerate(zip(template, toks)):
            if a != b:
                held = fillers.setdefault(i, {a} - {ANY})
                if len(held) < FILLERS:
                    held.add(b)
                template[i] = ANY
        self.messages[best] += 1
        self.documents[best] += documents
        return best

    def verdicts(self) -> list[str | None]:
        return [
            classify(" ".join(t), d, max((len(f - {CODE, NUMBER, NAME}) for f in held.values()), default=0), m)
            for t, d, m, held in zip(self.templates, self.documents, self.messages, self.fillers)
        ]


def classify(template: str, documents: int = 1, fillers: int = 0, messages: int = 1) -> str | None:
    """``error``, ``script`` or ``filler`` for a template of such messages, else null.

    ``documents`` have it, in ``messages`` different forms, with up to
    ``fillers`` different words in one place. A template in a place of which
    one word after another stands is a sentence that people write, whatever it
    tells of; a message is always the same, but for numbers and names. What
    stands in quotation marks is told of, too.
    """
    low = template.replace(ANY, " ")
    if any(_PATTERNS["filler"].finditer(low)) or is_dummy(low):
        return "filler"
    if template.count(" ") + 1 >= TOLD_TOKENS and fillers >= TOLD_FILLERS and fillers >= TOLD_SHARE * min(messages, 4 * FILLERS):
        return None
    if _BARE.fullmatch(re.sub(f"{CODE}|{NUMBER}", " ", low)):
        return "error"
    plain = re.sub(r"\"[^\"]{0,80}\"|“[^”]{0,80}”|'[^']{4,80}'(?!\w)", " ", low)
    if documents < RECURRING and _REPORTS.search(low):
        return None
    for kind in ("error", "script"):
        if _PATTERNS[kind].search(plain):
            return kind
    return "error" if documents >= RECURRING and fillers < 2 and _WEAKLY.search(plain) else None


def _flags(units: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(units, pattern).to_numpy(zero_copy_only=False).astype(bool)


_MINED = "doc bigint, kind string, leaf string, message string"


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of documents in which a cue stands, and documents with slots or stopgaps."""
    for batch in batches:
        texts = pc.replace_substring(batch.column(1), "’", "'")
        marked = np.flatnonzero(pc.match_substring(texts, "&").to_numpy(zero_copy_only=False).astype(bool))
        if len(marked):
            plain = texts.to_pylist()
            for i in marked:
                plain[i] = html.unescape(plain[i])
            texts = pa.array(plain, pa.string())
        split = pc.split_pattern_regex(pc.replace_substring_regex(texts, _BREAK, "\\1\n"), r"[\r\n]+")
        row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        units = pc.utf8_trim_whitespace(split.flatten())
        docs: list[int] = []
        kinds: list[str] = []
        leaves: list[str | None] = []
        messages: list[str | None] = []

        def put(at: np.ndarray, kind: str, leaf: str | None = None, message: str | None = None) -> None:
            docs.append(int(at))
            kinds.append(kind)
            leaves.append(leaf)
            messages.append(message)

        slot = _flags(units, _SLOT_CUE)
        some = np.flatnonzero(slot)
        for i, unit in zip(some, units.take(pa.array(some)).to_pylist()):
            if has_slot(unit):
                put(row[i], "slot")
        for i, text in enumerate(texts.to_pylist()):
            if repeats(text):
                put(i, "filler")
        cue, dummy = _flags(units, _CUES), _flags(units, "(?i)" + _DUMMY_CUE)
        some = np.flatnonzero(dummy & ~cue)
        for i, unit in zip(some, units.take(pa.array(some)).to_pylist()):
            if is_dummy(unit):
                put(row[i], "filler")
        some = np.flatnonzero(cue)
        for i, unit in zip(some, units.take(pa.array(some)).to_pylist()):
            if toks := tokens(_SLOT.sub(" ", unit) if slot[i] else unit):
                put(row[i], "message", leaf_of(toks), " ".join(toks))
        yield pa.record_batch(
            [batch.column(0).take(pa.array(docs, pa.int64())), pa.array(kinds, pa.string()), pa.array(leaves, pa.string()), pa.array(messages, pa.string())],
            ["doc", "kind", "leaf", "message"],
        )


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over messages in the order of their leaves: which template each joined, and at the end of a leaf its verdicts."""
    leaf, held, number = None, Leaf(), 0

    def finish() -> pa.RecordBatch:
        verdicts = held.verdicts()
        bad = [i for i, v in enumerate(verdicts) if v]
        return pa.record_batch(
            [pa.nulls(len(bad), pa.string()), pa.array([leaf] * len(bad), pa.string()), pa.array(bad, pa.int32()), pa.array([verdicts[i] for i in bad], pa.string())],
            ["message", "leaf", "template", "verdict"],
        )

    for batch in batches:
        joined: list[int] = []
        leaves = batch.column(0).to_pylist()
        for name, message, documents in zip(leaves, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if name != leaf:
                if leaf is not None:
                    yield finish()
                leaf, held = name, Leaf()
            joined.append(held.add(message.split(" "), documents))
        yield pa.record_batch(
            [batch.column(1), batch.column(0), pa.array(joined, pa.int32()), pa.nulls(len(joined), pa.string())], ["message", "leaf", "template", "verdict"]
        )
    if leaf is not None:
        yield finish()


def template_residue(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, defect)`` of documents with residue; ``defect`` is ``error``, ``script``, ``filler`` or ``slot``.

    Of the sentences and lines of a document those with a cue go into a
    fixed-depth prefix tree, partitioned by its leaves; equal ones are counted
    before. In each leaf, in order, messages join templates, whose places of
    varying words tell sentences about errors from messages. Every template is
    classified once, by its cues, its varying words and how many documents have
    it, and the verdict goes to its messages and their documents. Unresolved
    slots, words repeated over and over and dummy text are looked for in each
    sentence by itself, as a template would hide them. Null and empty texts
    have no residue; a repeated key gets what any of its rows has. The result
    doesn't depend on how the documents are partitioned.
    """
    docs = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where("text is not null")
    mined = stage(docs.mapInArrow(_mine, _MINED), "mined")
    said = mined.where("kind = 'message'")
    counted = said.groupBy("leaf", "message").agg(F.countDistinct("doc").alias("documents"))
    joined = stage(
        counted.repartition("leaf").sortWithinPartitions("leaf", "message").select("leaf", "message", F.col("documents").cast("int"))
        .mapInArrow(_templates, "message string, leaf string, template int, verdict string"),
        "templates",
    )
    bad = joined.where("verdict is not null").select("leaf", "template", "verdict")
    bad_messages = joined.where("message is not null").select("message", "leaf", "template").join(bad, ["leaf", "template"]).select("message", "verdict")
    by_template = said.join(bad_messages, "message").select(F.col("doc").alias(key), F.col("verdict").alias("defect"))
    alone = mined.where("kind <> 'message'").select(F.col("doc").alias(key), F.col("kind").alias("defect"))
    return by_template.unionByName(alone).distinct()
