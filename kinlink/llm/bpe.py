"""BPE encoding by a tokenization automaton, and decoding by its arc labels."""

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import words as W
from kinlink.llm.pretokens import PieceEncoder, added_tokens, byte_letters

# Transitions that a task keeps; they are looked up again after that many new ones.
TRANSITIONS = 200_000
# Bytes of texts that are encoded at once: their arrays take some thirty times as much.
SLICE = 1 << 20


class TokenAutomaton:
    """A deterministic automaton over tokens that accepts exactly the results of the merges.

    It starts as one state with a loop for each byte. The merge of u and v to w, number k,
    puts in a gadget: the state after u loses its arc v (a sequence u v is no longer final);
    the state after w begins as a copy of the state after v; and every state with an arc u
    gets an arc w. The state reached depends on the last token alone, so states are named by
    it, and a state is kept as its own lost arcs on top of the state it was copied from, each
    with the number of its merge: the copies share what they have in common. An arc t is
    missing from the state after s if one of its ancestors in the chain of copies lost, before
    the copying, t or a token that t was put in beside, before or when that happened. The table of transitions is filled as they are
    first met, and holds at most one entry for each pair of adjacent tokens.

    Every prefix of a piece is the text of exactly one accepted sequence, so reading a piece
    leaves one state at each position, found by table look-ups.
    """

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]):
        self.labels, self.met = tokens, 0
        # The token copied and the one put in beside, with the number of the merge: -1 for none.
        self.copied, self.beside, self.since = (array("i", [-1]) * len(tokens) for _ in range(3))
        # A lost arc has one number for state and token.
        self.lost: dict[int, int] = {}
        for k, (u, v, w) in enumerate(merges):
            self.lost[u * len(tokens) + v] = k
            self.copied[w], self.beside[w], self.since[w] = v, u, k

    def trie(self) -> dict:
        """The labels by their bytes; under -1 the token that ends there."""
        root: dict = {}
        for token, label in enumerate(self.labels):
            if label is not None and (self.copied[token] >= 0 or len(label) == 1):
                node = root
                for byte in label:
                    node = node.setdefault(byte, {})
                node[-1] = token
        return root

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow in the state after the token ``state``."""
        lost, copied, beside, merged = self.lost, self.copied, self.beside, self.since
        tokens = len(copied)
        until = len(lost)
        while True:
            arc, since = token, len(lost)
            while True:
                k = lost.get(state * tokens + arc)
                if k is not None and k < until and k <= since:
                    return False
                if beside[arc] < 0:
                    break
                arc, since = beside[arc], merged[arc]
            if copied[state] < 0:
                return True
            state, until = copied[state], merged[state]

    def encode(self, piece: bytes, trie: dict, table: dict[int, dict[int, bool]]) -> list[int]:
        """Tokens of one piece; ``table`` holds the transitions out of each state met so far."""
        n = len(piece)
        if self.met > TRANSITIONS:
            table.clear()
            self.met = 0
        states = [-1] * (n + 1)
        node = trie
        for j in range(n):
            node = node.get(piece[j])
            if node is None:
                break
            states[j + 1] = node.get(-1, -1)
        for i in range(1, n):
            state, node = states[i], trie
            row = table.get(state)
            if row is None:
                row = table[state] = {}
            for j in range(i, n):
                node = node.get(piece[j])
                if node is None:
                    break
                if states[j + 1] < 0 and -1 in node:
                    token = node[-1]
                    allowed = row.get(token)
                    if allowed is None:
                        allowed = row[token] = self.has_arc(state, token)
                        self.met += 1
                    if allowed:
                        states[j + 1] = token
        out = []
        while n:
            out.append(states[n])
            n -= len(self.labels[states[n]])
        return out[::-1]


def read_merges(vocabulary: str) -> tuple[list, list[tuple[int, int, int]], dict[str, int]]:
    """Labels, merges and added tokens of a byte-level BPE vocabulary file."""
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)["model"]
    back = {letter: byte for byte, letter in enumerate(byte_letters())}
    added = added_tokens(vocabulary)
    labels: list = [None] * (1 + max([*model["vocab"].values(), *added.values()]))
    for text, token in model["vocab"].items():
        if text not in added:
            labels[token] = bytes(back[c] for c in text)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = model["vocab"]
    for text, token in added.items():
        labels[token] = text.encode()
    return labels, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], added


def encode_decode(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns (id, n_tokens, ids_sha256, decoded_sha256), the digests in lowercase hex of the
    ids as little-endian unsigned 32 bits and of the decoded text in UTF-8, and with
    ``with_ids`` also ids array<int> and decoded. A null text is empty: no ids and an empty
    text. Rows are independent, so repeated rows and null ids come back as they are; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_merges(vocabulary))

    def convert(batches):
        labels, merges, added = shared.value
        automaton = TokenAutomaton(labels, merges)
        trie, table = automaton.trie(), {}
        encoder = PieceEncoder(lambda raw, spans: (automaton.encode(raw[s:e], trie, table) for s, e in spans), added)
        label = labels.__getitem__
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(offsets, SLICE):
                ids, counts = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(counts).tolist()
                one, two, texts, rows = [], [], [], []
                for start, end in zip([0, *ends[:-1]], ends):
                    own = ids[start:end]
                    text = b"".join(map(label, own.tolist())).decode("utf-8", "replace")
                    one.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    two.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        texts.append(text)
                        rows.append(own.astype(np.int32))
                columns = [batch.column(0).slice(a, b - a), pa.array(counts), pa.array(one), pa.array(two)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(rows, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.record_batch(columns, names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    out = rows.mapInArrow(W.tidy(convert), schema + (", ids array<int>, decoded string" if with_ids else ""))
    return out.withColumnRenamed("id", id_column)
