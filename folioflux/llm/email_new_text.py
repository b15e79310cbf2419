"""Problem 5: what the sender of a mail newly wrote, without quoted history, signatures and notes.

A mail is cut into blocks: at blank lines, where quoting begins or ends, and before lines that
look like the start of something (a line that introduces an earlier message, a header, a
signature delimiter, a closing phrase). Gradient-boosted trees classify the blocks by structure,
quote depth, contact density, how often the block comes in mails, and in those of the same sender (a
signature does), and whether it stands unquoted and nearer the start in another mail (an earlier
message does). The trees are fitted by fit() on a bounded sample labelled by cautious rules, varied
so that the labels outlast the marks that gave them, and lie beside this module.
"""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import gbt
from .runtime import spread, written

MODEL = Path(__file__).with_name("email_blocks.json")
#: Mails on which the trees are fitted at most.
SAMPLE = 5_000
#: Blocks of one wording that one task joins with their counts, and frequent wordings of which a table may be broadcast.
HEAVY, MOST_HEAVY = 50_000, 10_000

_PREFIX = re.compile(r"\s*([>|][>|\s]*)")
#: Verbs of lines that introduce an earlier message, and words of the lines above forwarded ones. Fixed values.
_WROTE = r"(?:wrote|a\s+écrit|schrieb|escribió|כתבה?|ha\s+scritto|schreef)"
_INTRO = re.compile(
    rf"^(?=.*\d)(?:(?:On|Le|Am|El|Op|Il|ב-?|בתאריך)\s.*{_WROTE}\b.*:|.*\b{_WROTE}\s+(?:on|am|le|el)\s+[\d./-]+\s*:|.*(?:^|\s){_WROTE}\s*:|\d{{2,4}}[./-]\d{{1,2}}[./-]\d{{1,4}},?\s+\S.*[^\s\d]\s*:)$"
)
_DATED = re.compile(r"^(?:On|Le|Am|El|Op|Il|ב|\d{2,4}[./-]\d{1,2})")
_FORWARD = re.compile(r"^-{3,}\s*(?:original message|forwarded message|message d'origine|message transféré|ursprüngliche nachricht|weitergeleitete nachricht|mensaje original|mensaje reenviado|הודעה מקורית|הודעה שהועברה)\s*-{3,}$", re.IGNORECASE)
_FROM = re.compile(r"^\*?(?:From|Von|De|מאת)\s?:\*?\s+\S")
_HEADER = re.compile(r"^\*?(?:From|Von|De|Sent|Date|Gesendet|Datum|Envoyé|Enviado|Enviado el|Fecha|To|An|À|A|Para|Cc|CC|Subject|Betreff|Objet|Asunto|מאת|נשלח|תאריך|אל|נושא)\s?:\*?(?:\s|$)")
_RULE = re.compile(r"^_{16,}$")
_DELIMITER = re.compile(r"^(?:--|—|_{2,15}|~{2,}|- - -|\*{3,}|={3,})$")
#: Closing phrases as whole lines. Fixed values.
_CLOSING = re.compile(
    r"^(?:br|rgds|(?:(?:best|kind|kindest|warm|with best|with kind) )?regards|cheers|thanks|thank you|many thanks|(?:many )?thanks and (?:best wishes|regards)|best|best wishes|all the best|sincerely|yours sincerely|yours faithfully|yours|"
    r"cordialement|bien cordialement|bien à vous|bonne journée|salutations|meilleures salutations|merci|sincères salutations|"
    r"(?:viele|beste|liebe|schöne|herzliche|freundliche) grüße|(?:mit )?(?:freundlichen|besten|herzlichen|vielen) grüßen|grüße|gruß|mfg|lg|vg|danke|vielen dank|"
    r"saludos|(?:saludos|un saludo) (?:cordiales|cordial)|un saludo|atentamente|un cordial saludo|gracias|"
    r"בברכה|תודה|תודה רבה|בברכה רבה|בכבוד רב)\s?[,.!]?$",
    re.IGNORECASE,
)
#: Notes of devices, and openings of disclaimers. Fixed values.
_DEVICE = re.compile(r"(?:^(?:sent|get|envoyé|von|gesendet|enviado|enviada|diese nachricht wurde|נשלח)\b.{0,40}(?:phone|tablet|mobile|mail app|téléphone|tablette|unterwegs|handy|móvil|teléfono|iphone|android|מהטלפון|מהנייד|מהטאבלט))|^von unterwegs gesendet|^נשלח מ", re.IGNORECASE)
_DISCLAIMER = re.compile(
    r"^(?:confidential(?:ity)?\b.{0,3}:|(?:this|the) (?:e-?mail|message) from \S+ is|this (?:e-?mail|message) (?:is|and)\b.*(?:intended|confidential|meant)|the views above are those|please think of the trees|"
    r"please think .*(?:trees|environment)|ce message de \S+ est confidentiel|\S+ décline toute responsabilité|diese (?:nachricht|e-?mail) .{0,60}vertraulich|\S+ haftet nicht|este mensaje de \S+ es confidencial|\S+ no responde por|הודעה זו\b.*חסוי)"
    r"|\baccepts no liability\b|if you got this in error",
    re.IGNORECASE,
)
_CONTACT = re.compile(r"[\w.+-]+\s?(?:@|\(at\)|\[at\])\s?[\w-]+|https?://|www\.|\+?\d[\d\s()./-]{6,}\d|^(?:t|tel|e|m|mail|mobile|phone|fax|ext)\b\.?:?", re.IGNORECASE)
_ADDRESS = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_SPACES = re.compile(r"\W+")

FEATURES = (
    "quoted", "depth", "intro", "headers", "rule", "delimiter", "closing", "open", "signed", "contacts", "words_line", "lines",
    "capitals", "sentence", "device", "disclaimer", "from_end", "from_start", "common", "ancestor", "sender",
)


class Block:
    __slots__ = ("first", "lines", "texts", "kind", "quoted", "depth", "open", "signed")

    def __init__(self, first: int, kind: str, depth: int):
        self.first, self.kind, self.depth = first, kind, depth
        self.lines: list[int] = []
        self.texts: list[str] = []
        self.quoted, self.open, self.signed = depth > 0, False, False


def _short(s: str) -> bool:
    return len(s.split()) <= 6 and not s.endswith((".", "?", "!"))


def blocks(content: str) -> list[Block]:
    """Blocks of a mail in order; lines are split at line feeds and counted from 1, blank ones belong to none."""
    raw = [x.rstrip("\r").strip() for x in content.split("\n")]
    n = len(raw)
    depth, bare = [0] * n, list(raw)
    for i, s in enumerate(raw):
        m = _PREFIX.match(s)
        if m:
            depth[i] = len(re.sub(r"\s", "", m.group(1)))
            bare[i] = s[m.end() :].strip()

    def after(i: int, count: int) -> list[int]:
        return [j for j in range(i + 1, min(n, i + 12)) if raw[j]][:count]

    kind = [""] * n
    for i, s in enumerate(raw):
        if not s or depth[i] or kind[i]:
            continue
        follow = after(i, 6)
        if _INTRO.match(s):
            kind[i] = "intro"
        elif _DATED.match(s) and not s.endswith((".", "!", "?")) and follow and follow[0] == i + 1 and not depth[i + 1] and _INTRO.match(f"{s} {raw[i + 1]}"):
            kind[i], kind[i + 1] = "intro", "intro2"
        elif _FORWARD.match(s):
            kind[i] = "intro"
        elif _FROM.match(s) and sum(bool(_HEADER.match(raw[j])) for j in follow[:5]) >= 2:
            kind[i] = "header"
        elif _RULE.match(s) and follow and _FROM.match(raw[follow[0]]) and sum(bool(_HEADER.match(raw[j])) for j in follow[1:]) >= 2:
            kind[i] = "rule"
        elif _DELIMITER.match(s) and (not follow or _short(raw[follow[0]])):
            kind[i] = "delimiter"
        elif _CLOSING.match(s):
            kind[i] = "closing"
        elif _DEVICE.search(s) and len(s.split()) <= 8:
            kind[i] = "device"
        elif _DISCLAIMER.search(s) and (i == 0 or not raw[i - 1]):
            kind[i] = "disclaimer"
    out: list[Block] = []
    for i, s in enumerate(raw):
        if not s:
            continue
        start = not out or not raw[i - 1] or bool(depth[i]) != out[-1].quoted or (kind[i] and kind[i] != "intro2") or (kind[i - 1] in ("intro", "intro2", "device") and kind[i] != "intro2")
        if start:
            out.append(Block(i + 1, kind[i], depth[i]))
        out[-1].lines.append(i + 1)
        out[-1].texts.append(bare[i])
        out[-1].depth = max(out[-1].depth, depth[i])
    opened = signed = False
    for k, b in enumerate(out):
        b.open, b.signed = opened, signed
        if b.quoted:
            signed = False
        elif b.kind in ("header", "rule") or (b.kind == "intro" and k + 1 < len(out) and not out[k + 1].quoted):
            opened = True
        elif b.kind in ("delimiter", "closing"):
            signed = True
    return out


def features(found: list[Block]) -> np.ndarray:
    """Structure and contact features of a mail's blocks; the last three columns are left for the counts over all mails."""
    rows = []
    for k, b in enumerate(found):
        words = [w for t in b.texts for w in t.split()]
        rows.append(
            (
                b.quoted, b.depth, b.kind == "intro", sum(bool(_HEADER.match(t)) for t in b.texts), b.kind == "rule", b.kind == "delimiter", b.kind == "closing", b.open, b.signed,
                sum(bool(_CONTACT.search(t)) for t in b.texts) / len(b.texts), len(words) / len(b.texts), len(b.texts),
                sum(w[:1].isupper() for w in words) / max(1, len(words)), sum(t.endswith((".", "!", "?")) for t in b.texts) / len(b.texts),
                b.kind == "device" or bool(_DEVICE.search(b.texts[0])), b.kind == "disclaimer" or bool(_DISCLAIMER.search(b.texts[0])), min(20, len(found) - k), min(20, k), 0.0, 0.0, 0.0,
            )
        )
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def block_hash(b: Block) -> int:
    """Hash of a block's words without its quoting, or of its lines where it has none."""
    text = _SPACES.sub(" ", " ".join(b.texts)).strip().lower() or "\n".join(b.texts)
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def sender_key(found: list[Block]) -> int | None:
    """Hash of who wrote a mail: the last address outside of earlier messages, else the name below the closing phrase or delimiter."""
    own = [b for b in found if not (b.quoted or b.open) and b.kind not in ("intro", "header", "rule", "disclaimer")]
    who = [a for b in own for t in b.texts for a in _ADDRESS.findall(t)][-1:]
    if not who:
        below = [t for b in own if b.signed or b.kind in ("closing", "delimiter") for t in b.texts[b.kind in ("closing", "delimiter") :]]
        who = [t for t in below if 2 <= len(t.split()) <= 4 and not _CLOSING.match(t) and not _CONTACT.search(t)][:1]
    return xxhash.xxh64_intdigest(" ".join(sorted(_SPACES.sub(" ", who[0].lower()).split()))) - (1 << 63) if who else None


def sure_label(f) -> int:
    """1 for a block that rules hold to be not newly written; for fitting only."""
    v = dict(zip(FEATURES, f))
    return int(any(v[k] > 0 for k in ("quoted", "intro", "rule", "delimiter", "closing", "open", "signed", "device", "disclaimer")) or v["headers"] >= 3)


def mails(segments: DataFrame) -> DataFrame:
    """(ord, content) of mails, repeated rows once; null contents are left out."""
    return segments.where((F.col("meta.content_type") == "email") & F.col("content").isNotNull() & F.col("ord").isNotNull()).select("ord", "content").distinct()


def block_rows(segments: DataFrame) -> DataFrame:
    """One row a block: (ord, mail, sender, block_no, lines, texts, h, quoted, f)."""

    def cut(batches):
        for batch in batches:
            out = []
            for ord_, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = blocks(content)
                # A mail that comes again with other line ends or spaces is no other mail.
                key = xxhash.xxh64_intdigest(" ".join(content.split()).encode("utf-8", "replace")) - (1 << 63)
                who = sender_key(found)
                for k, (b, f) in enumerate(zip(found, features(found).tolist())):
                    out.append((ord_, key, who, k, b.lines, b.texts, block_hash(b), b.quoted, f))
            cols = list(zip(*out)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["ord", "mail", "sender", "block_no", "lines", "texts", "h", "quoted", "f"])

    schema = "ord long, mail long, sender long, block_no int, lines array<int>, texts array<string>, h long, quoted boolean, f array<double>"
    return spread(mails(segments)).mapInArrow(cut, schema)


def _looked_up(rows: DataFrame, counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows with the counts of their keys; a key of more than HEAVY rows is joined in as many parts as it needs.

    Should more than MOST_HEAVY keys be so frequent, their parts are left to the engine's own skew join."""
    parts = F.ceil(F.col(n) / HEAVY).cast("int")
    heavy = counts.where(F.col(n) > HEAVY).select(*keys, parts.alias("parts")).limit(MOST_HEAVY + 1).toArrow()
    if not 0 < len(heavy) <= MOST_HEAVY:
        return rows.join(counts, keys, "left")
    few = F.broadcast(rows.sparkSession.createDataFrame(heavy))
    rows = rows.join(few, keys, "left").withColumn("part", F.pmod("mail", F.coalesce("parts", F.lit(1)).cast("long")).cast("int")).drop("parts")
    return rows.join(counts.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), [*keys, "part"], "left").drop("part")


def with_counts(rows: DataFrame) -> DataFrame:
    """Blocks with the number of mails, and of the sender's mails, that have the block, and whether another mail has it unquoted nearer its start.

    rows is read several times and should be a written table."""
    once = rows.groupBy("h", "mail").agg(F.first("sender").alias("sender"), F.min(F.when(~F.col("quoted"), F.col("block_no"))).alias("at"))
    # The first two mails by place: the first that isn't the block's own mail decides.
    two = F.row_number().over(Window.partitionBy("h").orderBy(F.col("at").asc_nulls_last(), "mail"))
    early = once.where("at is not null").select("h", "mail", "at", two.alias("r")).where("r <= 2").groupBy("h").agg(F.collect_list(F.struct("mail", "at")).alias("early"))
    by = once.where("sender is not null").groupBy("h", "sender").agg(F.count("*").alias("same"))
    of = once.groupBy("h").agg(F.count("*").alias("mails")).join(early, "h", "left")
    both = _looked_up(_looked_up(rows, of, ["h"], "mails"), by, ["h", "sender"], "same")
    common, sender = F.log2(F.col("mails").cast("double")), F.log2(F.coalesce("same", F.lit(1)).cast("double"))
    ancestor = F.coalesce(F.exists("early", lambda e: (e["mail"] != F.col("mail")) & (e["at"] < F.col("block_no"))), F.lit(False)).cast("double")
    n = len(FEATURES)
    return both.withColumn("f", F.concat(F.slice("f", 1, n - 3), F.array(common, ancestor, sender))).drop("mails", "early", "same")


def classified(segments: DataFrame, model: str = str(MODEL), texts: bool = True) -> DataFrame:
    """(ord, block_no, lines, texts, old): blocks with whether they were not newly written; without texts, texts is null."""
    rows = block_rows(segments)
    rows = written(rows if texts else rows.withColumn("texts", F.lit(None).cast("array<string>")), "mail-blocks")
    rows = with_counts(rows).select("ord", "block_no", "lines", "texts", "f")

    def decide(batches):
        trees = gbt.load(model)
        for batch in batches:
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(gbt.predict(trees, x) > 0)], names=["ord", "block_no", "lines", "texts", "old"])

    return rows.mapInArrow(decide, "ord long, block_no int, lines array<int>, texts array<string>, old boolean")


def found(segments: DataFrame, model: str = str(MODEL)) -> DataFrame:
    """Problem 5's cases: (ord, line_no) of non-blank lines of mails that were not newly written."""
    return classified(segments, model, texts=False).where("old").select("ord", F.explode("lines").alias("line_no")).distinct()


def new_text(segments: DataFrame, model: str = str(MODEL)) -> DataFrame:
    """(ord, text): the newly written blocks of every mail in order, a blank line between them; '' where there is none."""
    rows = classified(segments, model)
    kept = F.when(~F.col("old"), F.struct("block_no", F.array_join("texts", "\n").alias("t")))
    joined = rows.groupBy("ord").agg(F.array_sort(F.collect_list(kept)).alias("b"))
    return joined.select("ord", F.array_join(F.transform("b", lambda x: x["t"]), "\n\n").alias("text"))


class Runs:
    """Longest runs of a token list from any place of another, by a suffix automaton of the list: linear in both."""

    def __init__(self, tokens: list[str]):
        self.next, self.link, self.length, self.end = [{}], [-1], [0], [0]
        last = 0
        for place, t in enumerate(tokens, 1):
            new = self._state({}, self.length[last] + 1, place)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][t]
                if self.length[p] + 1 != self.length[q]:
                    copy = self._state(dict(self.next[q]), self.length[p] + 1, self.end[q])
                    self.link[copy] = self.link[q]
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[new] = q
            last = new

    def _state(self, after: dict, length: int, end: int) -> int:
        self.next.append(after)
        self.link.append(-1)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, tokens: list[str], i: int) -> tuple[int, int]:
        """(first place in the list, length) of the longest run that tokens have from i on."""
        state = n = 0
        while i + n < len(tokens) and (to := self.next[state].get(tokens[i + n])) is not None:
            state, n = to, n + 1
        return self.end[state] - n, n


def aligned(tokens: list[str], mail: list[str]) -> list[int]:
    """Place in a mail's tokens of every token of a text cut out of it, -1 where there is none.

    From the left, the longest run that the mail has is taken each time, where it stands first."""
    runs, out, i = Runs(mail), [-1] * len(tokens), 0
    while i < len(tokens):
        at, n = runs.longest(tokens, i)
        out[i : i + n] = range(at, at + n)
        i += n or 1
    return out


def new_chunk_text(segments: DataFrame, chunks: DataFrame, model: str = str(MODEL)) -> DataFrame:
    """(chunk_id, text, found): of every chunk made from a mail only what the mail's sender newly wrote, tokens between single spaces.

    A chunk has lost its mail's line ends, so its tokens are laid beside those of the mail (the
    segments whose source_filepath is the chunk's doc_id) and keep what their lines are there. found
    is the share of its tokens that the mail has; of several mails under a path the one with most
    counts, the first of equal ones. text is null where there is no such mail; '' where nothing is
    new. Chunks of other documents, with a null text or without chunk_id have no row; repeated rows
    have one; a chunk_id with different texts has one for each.
    """
    old = classified(segments, model, texts=False).where("old").groupBy("ord").agg(F.flatten(F.collect_list("lines")).alias("old"))
    mail = segments.where((F.col("meta.content_type") == "email") & F.col("content").isNotNull() & F.col("ord").isNotNull())
    mail = mail.select(F.col("meta.source_filepath").alias("doc_id"), "content", "ord").groupBy("doc_id", "content").agg(F.min("ord").alias("ord")).join(old, "ord", "left")
    own = chunks.where("chunk_id is not null and text is not null and lower(doc_id) like '%.eml'").select("chunk_id", "doc_id", "text").distinct()
    rows = own.join(mail, "doc_id", "left").select("chunk_id", F.xxhash64("text").alias("h"), "text", "ord", "content", "old")

    def lay(batches):
        for batch in batches:
            out = []
            for c, h, text, o, content, lines in zip(*(x.to_pylist() for x in batch.columns)):
                if content is None:
                    out.append((c, h, None, None, None))
                    continue
                gone, words, keep = set(lines or ()), [], []
                for k, line in enumerate(content.split("\n"), 1):
                    own = line.split()
                    words += own
                    keep += [k not in gone] * len(own)
                tokens = text.split()
                at = aligned(tokens, words)
                new = [t for t, p in zip(tokens, at) if p < 0 or keep[p]]
                out.append((c, h, o, sum(p >= 0 for p in at) / max(1, len(at)), " ".join(new)))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=["chunk_id", "h", "ord", "found", "text"])

    laid = rows.mapInArrow(lay, "chunk_id string, h long, ord long, found double, text string")
    best = laid.groupBy("chunk_id", "h").agg(F.max_by(F.struct("text", "found"), F.struct("found", -F.col("ord"))).alias("b"))
    return best.select("chunk_id", "b.text", F.coalesce("b.found", F.lit(0.0)).alias("found"))


def _joined(parts: list[tuple[list[str], int, Block]]) -> tuple[str, list[int | None]]:
    lines, labels = [], []
    for part, y, _ in parts:
        lines += [*([""] if lines else []), *part]
        labels += [*([None] if labels else []), *[y] * len(part)]
    return "\n".join(lines), labels


def varied(content: str, kind: int, rng: random.Random, notes: list[list[str]], shared: list[str]) -> list[tuple[str, list[int | None]]]:
    """Mails made of one whose blocks have sure labels, as (content, label by line; None where there is none).

    kind 0: as it is. 1: the signature without closing phrase and delimiter, where it holds contacts.
    2: a note or disclaimer instead of the signature, at the end or below a quotation. 3: short new
    lines without a full stop, of the mail or of many. 4: both. 5: a quotation without its marks, and
    the message quoted. 6: three mails of one sender, with the name apart from the contacts.
    7: the mail, and the same with other blocks before it and between.
    """
    found = blocks(content)
    f = features(found)
    raw = [x.rstrip("\r") for x in content.split("\n")]
    if kind == 5:
        quoted = [b for b in found if b.quoted and b.depth == 1]
        if quoted and not any(b.open for b in found):
            text = "\n\n".join("\n".join(b.texts) for b in quoted)
            own = [(b, sure_label(g)) for b, g in zip(found, f) if not b.quoted and b.kind != "intro"]
            new, old = ["\n".join(b.texts) for b, y in own if not y], ["\n".join(b.texts) for b, y in own if y]
            first = blocks(text)
            marks = {i: sure_label(g) for b, g in zip(first, features(first)) for i in b.lines}
            lines, labels = [], []
            for t, y in [*((t, 0) for t in new), *((t, 1) for t in ["\n".join(b.texts) for b in quoted]), *((t, 1) for t in old)]:
                part = t.split("\n")
                lines += [*part, ""]
                labels += [*[y] * len(part), None]
            return [("\n".join(lines), labels), (text, [marks.get(i + 1) for i in range(len(text.split("\n")))])]
    parts = [([raw[i - 1] for i in b.lines], sure_label(g), b) for b, g in zip(found, f)]
    top = lambda b: not b.quoted and not b.open
    cue = lambda b: top(b) and b.kind in ("closing", "delimiter")
    if kind == 1 and any(_CONTACT.search(t) for b in found if top(b) and (b.signed or cue(b)) for t in b.texts):
        out = []
        for lines, y, b in parts:
            lines = lines[1:] if cue(b) else lines
            if out and top(b) and top(out[-1][2]) and (b.signed or cue(b)) and (out[-1][2].signed or cue(out[-1][2])):
                out[-1] = (out[-1][0] + lines, y, out[-1][2])  # one block again
            else:
                out.append((lines, y, b))
        parts = [x for x in out if x[0]]
    if kind == 6:
        under = [t for b in found if top(b) and (b.signed or cue(b)) and b.kind not in ("device", "disclaimer") for t in b.texts[cue(b) :]]
        if len(under) > 1 and any(_ADDRESS.search(t) for t in under[1:]) and not _CONTACT.search(under[0]):
            body = [t for x in parts if not x[1] for t in re.split(r"(?<=[.!?])\s+", " ".join(x[0]))]
            made = []
            for k in range(3):
                own = [*body[k::3], *rng.sample(shared, 1)] if shared else body[k::3]
                lines = [x for t in [*own, under[0], "\n".join(under[1:])] for x in (*t.split("\n"), "")]
                made.append(("\n".join(lines), [None if not x else int(i >= 2 * len(own)) for i, x in enumerate(lines)]))
            return made
    if kind == 7 and shared:
        again = list(parts)
        for _ in range(2):
            free = [0, *(i + 1 for i, x in enumerate(again) if not x[1] or x[2].quoted and (i + 1 == len(again) or not again[i + 1][2].quoted))]
            again.insert(rng.choice(free), ([rng.choice(shared)], 0, Block(0, "", 0)))
        return [_joined(parts), _joined(again)]
    if kind in (2, 3, 4):
        if kind != 3 or rng.random() < 0.5:
            parts = [x for x in parts if not (top(x[2]) and (x[2].signed or cue(x[2])))]
        new = [k for k, x in enumerate(parts) if not x[1]]
        if kind != 2:
            words = [w.strip(".,;:!?()") for k in new for t in parts[k][0] for w in t.split()] or ["ok"]
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(words))
                short = [w for w in words[k : k + rng.randint(1, 6)] if w] or ["ok"]
                short[0] = rng.choice((short[0], short[0].capitalize()))
                places = [i + 1 for i, x in enumerate(parts) if not x[1] or x[2].quoted and (i + 1 == len(parts) or not parts[i + 1][2].quoted)]
                said = rng.choice((", " if len(short) > 2 else " ", " ")).join((short[0], " ".join(short[1:]))).strip(" ,")
                parts.insert(rng.choice(places or [0]), ([rng.choice(shared) if shared and rng.random() < 0.5 else said], 0, Block(0, "", 0)))
        if kind != 3 and notes:
            parts.append(([rng.choice(rng.choice(notes))], 1, Block(0, "", 0)))
    return [_joined(parts)]


def fit(segments: DataFrame) -> dict:
    """Trees fitted on the blocks of a bounded sample of mails (those of the smallest hashes).

    Every mail comes in each variation once; a round holds one variation of every mail, so that a
    mail never stands beside itself where blocks are counted.
    """
    spark = segments.sparkSession
    sample = [r.content for r in mails(segments).select("content").distinct().orderBy(F.xxhash64("content"), "content").limit(SAMPLE).collect()]
    cut = [b for c in sample for b in blocks(c) if b.kind in ("disclaimer", "device") and not b.quoted]
    notes = [x for k in ("disclaimer", "device") if (x := sorted({" ".join(b.texts) for b in cut if b.kind == k}))]
    said = [t.split() for c in sample for b in blocks(c) if not sure_label(features([b])[0]) for t in b.texts]
    xs, ys = [], []
    for turn in range(17):  # the last round holds the mails as they are, and counts for many
        rng, made = random.Random(turn), []
        shared = [" ".join(rng.choice(said)[: rng.randint(1, 5)]).strip(".,;:!?()") or "ok" for _ in range(20)] if said else []
        for k, c in enumerate(sample):
            made += varied(c, (k + turn) % 8 if turn < 16 else 0, rng, notes, shared)
        rows = spark.createDataFrame([(i, c, ("email",)) for i, (c, _) in enumerate(made)], "ord long, content string, meta struct<content_type:string>")
        for r in with_counts(block_rows(rows)).select("ord", "lines", "f").orderBy("ord", "block_no").collect():
            own = [made[r.ord][1][i - 1] for i in r.lines]
            xs += [r.f] * (1 if turn < 16 else 7)
            ys += [float(2 * sum(own) >= len(own))] * (1 if turn < 16 else 7)
    return gbt.fit(np.array(xs), np.array(ys))
