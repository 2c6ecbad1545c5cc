"""Language of mixed texts: scripts narrow the candidates, Viterbi labels the words."""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import words as W

BUCKETS = 1 << 16
# Words that one step of the search takes side by side; longer texts are several pieces.
PIECE = 256
# Up to this many labels texts are cut into pieces, each searched from every label; more labels
# make that dearer than going through long texts word by word.
FEW_LABELS = 16
# States of one group of texts.
CELLS = 1 << 25
# Natural log of the odds against a change of language between two words.
SWITCH = 8.0
# Log likelihoods: what is added to each count, and the share of a language's letters that a
# script must have to be one of its scripts.
SMOOTH = 0.5
LEAST_SHARE = 0.001
# First and last code point of the scripts told apart; the rest is script 0.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("ethiopic", 0x1200, 0x137F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FFFF),
]


def _script_table() -> np.ndarray:
    names = list(dict.fromkeys(name for name, _, _ in SCRIPTS))
    table = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        table[first : last + 1] = 1 + names.index(name)
    return table


def _letters(points: np.ndarray) -> np.ndarray:
    """Letters and the marks that go with them."""
    seen = np.bincount(points)
    table = np.zeros(len(seen), bool)
    for point in np.flatnonzero(seen).tolist():
        table[point] = unicodedata.category(chr(point))[0] in "LM"
    return table[points]


def text_words(data: np.ndarray, offsets: np.ndarray, scripts: np.ndarray):
    """Words of each text of a slice: runs of lower-cased letters of one script.

    Returns (points, starts, ends, owner, script of each word), in code points of the slice,
    and where the texts begin in them.
    """
    text = data.tobytes().decode("utf-8").replace("İ", "I").lower()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[offsets]
    if not len(points):
        none = np.zeros(0, np.int64)
        return points, none, none, none, none, at
    inside, script = _letters(points), scripts[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[at] = True
    change = edge[1:-1] | (script[1:] != script[:-1])
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | change
    closes[:-1] &= ~inside[1:] | change
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return points, starts, ends, np.searchsorted(at, starts, "right") - 1, script[starts], at


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """A bucket for each letter of each word with its neighbours, word ends being neighbours too."""
    sizes = ends - starts
    upto = np.cumsum(sizes)
    place = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + sizes, sizes)
    own = points[place].astype(np.uint64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[upto - sizes] = 0
    after[upto - 1] = 0
    key = (before << np.uint64(42)) | (own << np.uint64(21)) | after
    return (W.mix(key, 5) & np.uint64(BUCKETS - 1)).astype(np.int64), upto


def train(texts: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log likelihood of each bucket in each, and which scripts each has.

    ``texts``: (text, lang). Counts cover every text; what comes back is bounded by the
    buckets and scripts times the number of languages.
    """

    def counted(batches):
        scripts = _script_table()
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b in W.slices(offsets):
                points, starts, ends, owner, script, _ = text_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], scripts)
                for lang in set(langs[a:b]):
                    mine = (langs[a:b] == lang)[owner]
                    sizes = (ends - starts)[mine]
                    total = totals.setdefault(lang, np.zeros(BUCKETS + 256, np.int64))
                    total[:BUCKETS] += np.bincount(grams(points, starts[mine], ends[mine])[0], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script[mine], sizes, 256).astype(np.int64)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.record_batch(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used])],
                ["lang", "cell", "count"],
            )

    rows = texts.select("text", "lang").mapInArrow(W.tidy(counted), "lang string, cell int, count long")
    table = rows.groupBy("lang", "cell").agg(F.sum("count").alias("count")).toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    code = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS + 256))
    lang = np.array([code[x] for x in table["lang"].to_pylist()], np.int64)
    counts[lang, table["cell"].to_numpy()] = table["count"].to_numpy()
    seen = counts[:, :BUCKETS] + SMOOTH
    scripts = counts[:, BUCKETS:]
    uses = scripts >= np.maximum(LEAST_SHARE * scripts.sum(1, keepdims=True), 1)
    return names, np.log(seen / seen.sum(1, keepdims=True)).astype(np.float32), uses


def best_path(scores: np.ndarray, owner: np.ndarray, switch: float) -> np.ndarray:
    """Label of each word: the best sum of scores less ``switch`` for each change, in each text.

    Texts are taken in groups of at most ``CELLS`` states, so memory follows neither the slice
    nor the square of the labels; a text larger than that is a group of its own.
    """
    n, labels = scores.shape
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(first, n))
    starts = labels + 1 if labels <= FEW_LABELS else 1
    group = (np.cumsum(sizes) - sizes) * starts * labels // CELLS
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    edges = [*first[cuts].tolist(), n]
    out = np.empty(n, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        out[a:b] = _group_paths(scores[a:b], owner[a:b], switch, PIECE if starts > 1 else None)
    return out


def _group_paths(scores: np.ndarray, owner: np.ndarray, switch: float, piece: int | None) -> np.ndarray:
    """``best_path`` of a few texts, which are searched side by side.

    With ``piece`` texts are cut into pieces of so many words, and each is searched once from
    each label before it and once free; the pieces of a text are then put together from these,
    which gives the same result as one search over the whole text. Without, a text is one piece
    that is searched free. A state keeps whether it stayed, and a step its best label before.
    """
    n, labels = scores.shape
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(first, n))
    most = piece or int(sizes.max())
    fixed = labels if piece else 0
    each = -(-sizes // most)
    number = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    begin = np.repeat(first, each) + number * most
    length = np.minimum(np.repeat(sizes, each) - number * most, most)
    order = np.argsort(-length, kind="stable")
    begin, length, rank = begin[order], length[order], np.argsort(order)
    pieces = len(begin)
    state = np.full((pieces, fixed + 1, labels), -1e30, np.float32)
    state[:, fixed] = 0
    state[:, np.arange(fixed), np.arange(fixed)] = 0
    steps = int(length.max())
    kind = np.uint8 if labels <= 1 << 8 else np.uint16 if labels <= 1 << 16 else np.int32
    stay, top = [], []
    for t in range(steps):
        live = int(np.searchsorted(-length, -t, "left"))
        now = state[:live]
        best = now.argmax(2)
        jump = np.take_along_axis(now, best[:, :, None], 2) - np.float32(switch)
        keep = now >= jump
        state[:live] = np.where(keep, now, jump) + scores[begin[:live] + t][:, None, :]
        stay.append(keep)
        top.append(best.astype(kind))
    # Along each text: the label before each piece that leads to the best end.
    into, label = np.empty(pieces, np.int64), np.empty(pieces, np.int64)
    rank_of = rank.tolist()
    at = 0
    for count in each.tolist():
        own = rank_of[at : at + count]
        at += count
        value, came = state[own[0], fixed], []
        for p in own[1:]:
            reach = value[:, None] + state[p, :fixed]
            came.append(reach.argmax(0))
            value = reach.max(0)
        end = int(value.argmax())
        for p, back in zip(own[:0:-1], came[::-1]):
            label[p], into[p] = end, back[end]
            end = int(back[end])
        label[own[0]], into[own[0]] = end, fixed
    out = np.empty(n, np.int64)
    for t in range(steps - 1, -1, -1):
        live = len(stay[t])
        rows = np.arange(live)
        out[begin[:live] + t] = label[:live]
        same = stay[t][rows, into[:live], label[:live]]
        label[:live] = np.where(same, label[:live], top[t][rows, into[:live]])
    return out


def identify(
    docs: DataFrame,
    model: tuple[list[str], np.ndarray, np.ndarray],
    id_column: str = "doc_id",
    text_column: str = "text",
    with_spans: bool = False,
    switch: float = SWITCH,
) -> DataFrame:
    """(id, lang_pred, score) of every whole text, and with ``with_spans`` its labelled spans.

    A word's candidates are the languages that use its script (all, if none does); its score
    in each is the log likelihood of its letters with their neighbours. The best sequence of
    labels of the words, with a penalty for each change, gives the spans (start, length,
    lang) in characters. The prediction is the language of most letters and the score their
    share. A text that is null or has no letter is ``und`` with score 0 and no spans; so is
    every text if nothing was learned. Rows are independent, so repeated rows and null ids
    come back as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches):
        names, likely, uses = shared.value
        scripts = _script_table()
        allowed = uses.T | ~uses.any(0)[:, None] if names else None
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(offsets):
                rows = b - a
                points, starts, ends, owner, script, at = text_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], scripts)
                letters = np.zeros((rows, max(len(names), 1)))
                spans: list[list] = [[] for _ in range(rows)]
                if len(starts) and names:
                    bucket, upto = grams(points, starts, ends)
                    first = upto - (ends - starts)
                    scores = np.stack([np.add.reduceat(row[bucket], first) for row in likely], 1)
                    scores = np.where(allowed[script], scores, np.float32(-1e6))
                    path = best_path(scores, owner, switch)
                    letters = np.bincount(owner * len(names) + path, ends - starts, rows * len(names)).reshape(rows, -1)
                    if with_spans:
                        cut = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
                        last = np.append(cut[1:], len(path)) - 1
                        for i, j in zip(cut.tolist(), last.tolist()):
                            o = int(owner[i])
                            spans[o].append({"start": int(starts[i] - at[o]), "length": int(ends[j] - starts[i]), "lang": names[path[i]]})
                total = letters.sum(1)
                best = letters.argmax(1)
                share = np.divide(letters[np.arange(rows), best], total, out=np.zeros(rows), where=total > 0)
                columns = [
                    batch.column(0).slice(a, rows),
                    pa.array([names[k] if t else "und" for k, t in zip(best.tolist(), total.tolist())], pa.string()),
                    pa.array(share, pa.float64()),
                ]
                if with_spans:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())]))
                    columns.append(pa.array(spans, kind))
                yield pa.record_batch(columns, ["id", "lang_pred", "score", "spans"][: len(columns)])

    schema = "id long, lang_pred string, score double" + (", spans array<struct<start: int, length: int, lang: string>>" if with_spans else "")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(W.tidy(labelled), schema).withColumnRenamed("id", id_column)


def held_out(id_column: str, parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text leaves the remainder ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(False))


def language(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learn from the documents not held out, label all."""
    learn = docs.where(~held_out(id_column) & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    model = train(learn.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")))
    found = identify(docs, model, id_column, text_column)
    return found.select(id_column, held_out(id_column).alias("held_out"), "lang_pred", "score")
