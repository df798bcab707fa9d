"""Abusive, hateful or sexual language: words taken back from disguise, features of sentences, and a chain of linear models.

Texts are cut into segments (sentences, or windows of a long one), and every segment is scored. Its features are its words
and pairs of neighbouring words, character n-grams of words that the training sample doesn't know, and, as weak features
among them, whether words of some lists occur. All weights are learned from labelled documents; without labels of both
kinds nothing is flagged. The chain predicts insult, threat, hate and sexual content one after the other and toxicity
last; each model sees the probabilities of the ones before it, which in training come from models that haven't seen the
document.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

CATEGORIES = ("insult", "threat", "hate", "sexual", "toxic")

# fixed values: words that carry a category, without accents, in several languages
INSULTS = """
idiot idiots moron morons imbecile imbeciles dimwit dimwits halfwit halfwits nitwit nitwits twit loser losers jerk jerks scum scumbag
asshole assholes arsehole arse dickhead dickheads prick cunt cunts bitch bitches whore whores slut sluts slag wanker wankers tosser twat douche douchebag retard retards retarded
cretin pig swine cockroach parasite parasites dumbass jackass dipshit shithead shitheads fuckwit fuckhead motherfucker motherfuckers bellend numbskull pathetic worthless brainless braindead clown
fool fools dullard dunce simpleton buffoon weirdo creep coward lowlife degenerate crybaby snowflake faggot fag dyke tranny nigger nigga chink spic kike paki gook
vollidiot vollidioten versager arschloch arschlocher hurensohn wichser schlampe fotze depp trottel dummkopf missgeburt abschaum spast spasti penner drecksau
connard connards connasse salope pute encule abruti abrutis cretine debile ordure bouffon salaud
idiotas imbeciles pendejo pendejos cabron puta puto gilipollas estupido estupida inutil subnormal maricon zorra basura
stronzo coglione cazzo troia puttana bastardo idioti imbecille otario burro merdoso viado klootzak hoer kurwa debil idiotka pizdec suka blyat mudak
馬鹿 ばか バカ アホ 死ね クズ 傻逼 白痴 蠢货 废物 垃圾人 滚蛋 笨蛋
""".split()
PROFANITY = "bastard bastards fuck fucks fucking fucked fucker shit shits shitty bullshit crap crappy damn goddamn hell piss pissed ass arse wtf stfu gtfo scheisse scheiss verdammt merde putain mierda joder cono hostia porra caralho klappe gueule degage callate maul verpiss casse 他妈的 くそ".split()
THREATS = """
kill killing murder die dies shoot stab strangle smash beat break broken burn rape hang lynch choke slaughter punch slap kick hunt hurt destroy cripple bullet knife gun neck throat fingers bones legs teeth skull
cancer starve suicide suffer rot bleed regret buried grave umbringen toten sterben verreck schlag brechen mourir creve crever tuer frapper casser matar morir muere golpear romper 殺す 杀了 去死 殴る
""".split()
GROUPS = """
immigrants immigrant foreigners foreigner women woman female females girls girl men gay gays lesbian lesbians trans transgender queer muslims muslim jews jew jewish christians christian hindus believers atheists blacks black whites asians asian
africans african arabs arab mexicans indians chinese russians gypsies gypsy disabled cripples autistic old elderly people accents accent country countries race races religion religions south north east kind refugees migrants natives poor
auslander frauen schwule juden turken fluchtlinge behinderte etrangers femmes arabes juifs musulmans noirs inmigrantes extranjeros mujeres negros judios moros gays 移民 外国人 女人 外人 女
""".split()
DEGRADES = """
vermin subhuman subhumans banned ban disgust disgusts disgusting filthy inferior stupid animals savages savage plague infest infested deport deported dirty lazy criminals thieves steals steal begs beg brain brains washing dishes kitchen belong belongs deserve exterminate
eliminate gassed rats monkeys apes untermensch ungeziefer raus parasiten vermine sale rentre sucios fuera ratas
""".split()
SEXUAL = """
sex sexy sexual nude nudes naked porn porno pornos pornography horny tits tit boobs boob breasts cock cocks dick dicks penis pussy vagina cum blowjob handjob orgasm erotic webcam cam cams strip stripper bed lingerie slutty masturbate masturbating
hentai nsfw escort escorts hookup milf threesome dildo fetish explicit seduce moan thong panties undress topless booty sext nackt nackte titten ficken geil sexfilme nue nues baiser seins desnuda desnudas desnudos follar tetas culo nuda scopare 裸 エロ 色情 做爱 裸体
""".split()
TARGETS = "you your yours yourself yourselves u ur youre du dich dir dein deine deiner euch ihr tu te toi ton ta tes vous votre ti usted ustedes vosotros her him his she he them they their 你 您 お前 おまえ あなた 君".split()
SECOND = "you your yours yourself yourselves u ur youre du dich dir dein deine deiner euch tu te toi ton ta tes vous votre ti usted ustedes ya 你 您 お前 おまえ".split()
SELF = "i my mine myself me im ich mein je moi mon yo mi we our".split()
TECHNICAL = """
macro build test tests typo hack patch code function compiler log worker workers process processes thread threads child parent zombie orphan orphaned pointer handle handles column enum values dataset decoder gateway testing cache tmpfs page lookup
heartbeat fork bomb host attack surface interface mount hot plug master slave node cluster job timer daemon signal command script session loop bug linker kernel driver socket queue form parser imaging sample loader analysis assessment class git branch commit
""".split()
MENTIONS = "forbids forbid calling calls conduct policy report survey rated filter filters rejects messages such counts word words list column test tests example examples quoted blocks detects rule rules moderation strings term terms wordlist".split()

# fixed values: look-alike letters
_ALIKE = str.maketrans(
    "аеорсухіјѕԁһӏкмтвнпгАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοειкνρτυχϲ",
    "aeopcyxijsdhlkmtbhnrABEKMHOPCTYXIJSABEZHIKMNOPTYXaoeiknptuxc",
)
_LEET = str.maketrans("0134578@$", "oieastbas")
_LEET_L = str.maketrans("0134578@$", "oleastbas")
# fixed values: ranges of characters that don't show
_HIDDEN = frozenset(chr(c) for a, b in ((0x00ad, 0x00ad), (0x034f, 0x034f), (0x061c, 0x061c), (0x115f, 0x115f), (0x1160, 0x1160), (0x17b4, 0x17b4), (0x17b5, 0x17b5), (0x180b, 0x180e), (0x200b, 0x200f), (0x202a, 0x202e), (0x2060, 0x2064), (0x206a, 0x206f), (0x3164, 0x3164), (0xfe00, 0xfe0f), (0xfeff, 0xfeff)) for c in range(a, b + 1))
_STRETCH = re.compile(r"([a-z])\1{2,}")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")

SETS = {"insult": frozenset(INSULTS), "profanity": frozenset(PROFANITY), "threat": frozenset(THREATS), "group": frozenset(GROUPS), "degrade": frozenset(DEGRADES), "sexual": frozenset(SEXUAL)}
_STRONG = SETS["insult"] | SETS["sexual"] | {"fuck", "fucking", "shit", "vermin", "subhuman", "subhumans", "kill", "klappe", "nudes", "versager"}
_ALL = frozenset().union(*SETS.values())
_TARGETS, _SECOND, _SELF, _TECHNICAL, _MENTIONS = map(frozenset, (TARGETS, SECOND, SELF, TECHNICAL, MENTIONS))
LISTS = {**SETS, "target": _TARGETS, "second": _SECOND, "self": _SELF, "technical": _TECHNICAL, "mention": _MENTIONS}


@lru_cache(maxsize=1)
def _marks() -> frozenset:
    """All combining marks."""
    return frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c)))


_LOOKS = frozenset(map(chr, _ALIKE))
_MIXED = re.compile(r"\w+")


def _without(text: str, unwanted: frozenset) -> str:
    for c in unwanted.intersection(text):
        text = text.replace(c, "")
    return text


def plain(text: str) -> str:
    """Lower case without accents, invisible characters and look-alikes."""
    if not text.isascii():
        text = _without(unicodedata.normalize("NFKC", text), _HIDDEN)
        if not text.isascii():
            # letters of another script count as look-alikes only in words that have Latin ones
            if not _LOOKS.isdisjoint(text):
                text = _MIXED.sub(lambda m: m[0].translate(_ALIKE) if not m[0].isascii() and re.search("[A-Za-z]", m[0]) else m[0], text)
            text = _without(unicodedata.normalize("NFD", text), _marks())
    return text.lower()


class Known(NamedTuple):
    """Words that a disguised one may stand for: those of the lists, and those that tell in the training sample."""

    words: frozenset
    masks: dict  # first letter, last letter and length -> words, in order
    longest: int

    @staticmethod
    def of(learned: frozenset) -> Known:
        masks: dict[tuple[str, str, int], list[str]] = {}
        for w in sorted(_STRONG | learned, key=lambda w: (w not in _STRONG, w not in SETS["profanity"], w)):
            if len(w) > 2:
                masks.setdefault((w[0], w[-1], len(w)), []).append(w)
        return Known(_ALL | learned, masks, max(map(len, _ALL | learned | _TARGETS)))


def undisguise(word: str, known: Known) -> tuple[str, bool]:
    """A word taken back from digits, stretched letters and stars, and whether it was disguised as a known one."""
    if word in known.words:
        return word, False
    if (word.isalpha() or len(word) > known.longest and "*" not in word) and not _STRETCH.search(word):
        return word, False
    if "*" in word:
        if word[-1] != "*" and word[0] != "*":
            shape = re.compile(re.escape(word).replace(r"\*", ".") + "$")
            hit = next((w for w in known.masks.get((word[0], word[-1], len(word)), ()) if shape.match(w)), None)
            if hit:
                return hit, True
        bare = word.strip("*")
        return (bare, True) if bare in known.words and len(bare) > 2 else (word.replace("*", ""), False)
    if word in _TARGETS:
        return word, False
    forms = [word]
    if any(c in "0134578@$" for c in word) and any(c.isalpha() for c in word):
        forms += [word.translate(_LEET), word.translate(_LEET_L)]
    for f in forms:
        if f in known.words:
            return f, f != word
        if _STRETCH.search(f):
            for g in (_STRETCH.sub(r"\1", f), _STRETCH.sub(r"\1\1", f)):
                if g in known.words:
                    return g, True
                if g in _TARGETS:
                    return g, False
    return word, False


#: Tokens: words, characters of other scripts, quotation marks, and ends of sentences.
_TOKENS = re.compile(r"[a-z0-9@$*]+|[^\W\d_a-z]+|[\"“”«»`‘’]|\n|[.!?](?=[^\w@$*.!?\n]|_)|[。！？]")
# for ASCII the same by plain replacements, several times as fast; a zero byte stands for a sentence's end
_FIRST = str.maketrans({c: c if c.isalnum() or c in "@$*\".!?\n" else '"' if c == "`" else " " for c in map(chr, range(128))})
_LAST = str.maketrans(".!?", "   ")
_ENDS = frozenset("\0\n.!?。！？")
_QUOTES = frozenset("\"“”«»`‘’")
#: Tokens at most in one segment, and tokens by which the windows of a longer sentence go on.
LONGEST, STEP = 60, 30
#: Buckets for the character n-grams of unknown words.
BUCKETS = 1 << 14


def tokens_of(text: str) -> list[str]:
    text = plain(text)
    if not text.isascii():
        return _TOKENS.findall(text)
    text = text.translate(_FIRST)
    for end in ".!?":
        if end in text:
            text = text.replace(f"{end} ", " \0 ").replace(f'{end}"', ' \0 "')
    return text.replace("\n", " \0 ").replace('"', ' " ').translate(_LAST).split()


_FLAGS = ("disguised", "masked", *LISTS)
_BIT = {f: k for k, f in enumerate(_FLAGS)}
#: Columns of lists: present, twice, and combinations.
LIST_FEATURES = (*[f"{f}" for f in _FLAGS], *[f"{f}_twice" for f in SETS], "insult_at", "profanity_at", "sexual_at", "threat_at", "group_degrade", "profanity_technical")


def _bits() -> dict[str, int]:
    out: dict[str, int] = {}
    for name, members in LISTS.items():
        for w in members:
            out[w] = out.get(w, 0) | 1 << _BIT[name]
    return out


_LISTED = _bits()


class Type(NamedTuple):
    """What a token stands for: columns of the model, the number of its word for pairs (-1: none), and bits of its lists."""

    columns: tuple
    word: int
    bits: int


class Lexicon:
    """Columns of the model: 0 is the bias, then those of lists, words, pairs of words, and buckets of n-grams."""

    def __init__(self, words: dict[str, int], pairs: np.ndarray, known: Known):
        self.words, self.pairs, self.known = words, pairs, known
        self.first_word = 1 + len(LIST_FEATURES)
        self.first_pair = self.first_word + len(words)
        self.first_bucket = self.first_pair + len(pairs)
        self.width = self.first_bucket + BUCKETS

    def _word(self, token: str, bits: int) -> Type:
        n = self.words.get(token)
        return Type((), -1, bits) if n is None else Type((self.first_word + n,), n, bits)

    def type_of(self, token: str) -> Type:
        if token in _QUOTES:
            return self._word('"', 0)
        token = token.lstrip("*")
        if not token:
            return Type((), -1, 0)
        if token.isdigit() or token in ("#", "#x"):
            return self._word(token if token == "#x" else "#", 0)
        was = False
        if token not in self.known.words:
            token, was = undisguise(token, self.known)
        bits = _LISTED.get(token, 0)
        if was:
            bits |= 1 << _BIT["disguised"]
        if token in self.words:
            return self._word(token, bits)
        if token[0] == "@":
            return self._word("@", bits | 1 << _BIT["target"] | 1 << _BIT["second"])
        if _CJK.match(token):  # no spaces between words: character n-grams, and words of the lists anywhere in it
            parts = {token[k : k + n] for n in (1, 2, 3, 4) for k in range(len(token) - n + 1)}
            for p in parts:
                bits |= _LISTED.get(p, 0)
            return Type(self._buckets({p for p in parts if len(p) in (2, 3)} or parts), -1, bits)
        if "*" in token:
            return self._word("*", bits | 1 << _BIT["masked"])
        if not token.isalpha():
            return self._word("#x", bits)
        shown = f"<{token}>"
        return Type(self._buckets({shown[k : k + 4] for k in range(max(1, len(shown) - 3))}), -1, bits)

    def _buckets(self, grams: set[str]) -> tuple:
        return tuple(sorted({self.first_bucket + zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams}))


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


class Encoded(NamedTuple):
    """Segments of a batch of texts: of each its text, and where its tokens stand; distinct pairs (segment, type); pairs of
    words (segment, column); bits of lists by segment."""

    text: np.ndarray
    spans: np.ndarray  # segments by 2: first token and one after the last, in the text's tokens
    type_seg: np.ndarray
    type_no: np.ndarray
    pair_seg: np.ndarray
    pair_col: np.ndarray
    lists: np.ndarray  # segments by LIST_FEATURES, boolean


class _Numbers(dict):
    def __init__(self, new, longest: int):
        super().__init__(dict.fromkeys(_ENDS, 0))
        self.new, self.longest = new, longest

    def __missing__(self, token: str) -> int:
        # numbers and long mixtures, of which there is no end, stand for one another
        if len(token) > 1 and token.isdigit():
            return self["#"]
        if len(token) > self.longest and token.isascii() and not token.isalpha() and "*" not in token and token[0] != "@" and not _STRETCH.search(token):
            return self["#x"]
        n = self[token] = self.new(token)
        return n


class Encoder:
    """Turns texts into segments. Types are numbered as they come; ``types`` has them in that order."""

    #: Types kept at most; beyond that the table starts anew, which costs time only.
    KEPT = 400_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self._clear()

    def _clear(self) -> None:
        self.times_cleared = getattr(self, "times_cleared", -1) + 1
        self.numbers = _Numbers(self._number, max(self.lexicon.known.longest, max(map(len, self.lexicon.words), default=0)))
        self.apart: dict[str, list] = {}
        self.names: list[str] = ["\n"]
        self.types: list[Type] = [Type((), -1, 0)]
        self.columns = np.zeros((0, 3), np.int64)  # word, bits, and whether it is a single letter, by type

    def _number(self, token: str) -> int:
        self.names.append(token)
        self.types.append(self.lexicon.type_of(token))
        return len(self.types) - 1

    def _of_types(self) -> np.ndarray:
        done = len(self.columns)
        if done < len(self.types):
            new = [(t.word, t.bits, len(name) == 1 and name.isascii() and (name.isalnum() or name in "@$")) for t, name in zip(self.types[done:], self.names[done:])]
            self.columns = np.concatenate([self.columns, np.array(new, np.int64)])
        return self.columns

    def stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Types of all tokens with a sentence's end after each text, the place of each among the tokens as read, and where
        the texts begin. Letters apart count as one token where they give a known word."""
        if len(self.types) > self.KEPT:
            self._clear()
        number = self.numbers.__getitem__
        ids, starts = [], []
        for t in texts:
            starts.append(len(ids))
            ids.extend(map(number, tokens_of(t)))
            ids.append(0)
        ids = np.array(ids, np.int64)
        place = np.arange(len(ids))
        single = np.concatenate(([0], self._of_types()[ids, 2], [0]))
        edge = np.flatnonzero(single[1:] != single[:-1])
        gone = np.zeros(len(ids), bool)
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a > 2:
                self._close(ids, gone, a, b)
        keep = ~gone
        return ids[keep], place[keep], np.array(starts, np.int64)

    def _close(self, ids: np.ndarray, gone: np.ndarray, a: int, b: int) -> None:
        letters = "".join([self.names[k] for k in ids[a:b].tolist()])
        found = self.apart.get(letters)
        if found is None:
            found = self._words_in(letters)
            if len(letters) < 30 and len(self.apart) < self.KEPT:
                self.apart[letters] = found
        for at, end, word in found:
            ids[a + at] = self.numbers[word]
            gone[a + at + 1 : a + end] = True

    def _words_in(self, letters: str) -> list[tuple[int, int, str]]:
        """The longest known words in a run of single letters, from left to right."""
        known, out, at = self.lexicon.known, [], 0
        while at < len(letters) - 2:
            for end in range(min(len(letters), at + 24), at + 2, -1):
                found, _ = undisguise(letters[at:end], known)
                if found in known.words and (end - at > 3 or found in _STRONG):
                    out.append((at, end, f"{found}*"))  # a star: it was disguised
                    at = end
                    break
            else:
                at += 1
        return out

    def segments(self, ids: np.ndarray, place: np.ndarray, starts: np.ndarray):
        """Of each segment its text and its tokens; of each token of a segment its segment and type."""
        ends = np.flatnonzero(ids == 0)
        begin = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else np.zeros(0, np.int64)
        keep = ends > begin
        begin, ends = begin[keep], ends[keep]
        # a long sentence becomes windows
        size = ends - begin
        n_win = np.where(size > LONGEST, (np.maximum(size - LONGEST, 0) + STEP - 1) // STEP + 1, 1)
        which = np.repeat(np.arange(len(begin)), n_win)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        a = begin[which] + nth * STEP
        b = np.minimum(a + LONGEST, ends[which])
        text = np.searchsorted(starts, place[a], side="right") - 1
        lens = b - a
        seg = np.repeat(np.arange(len(a)), lens)
        tok = ids[np.arange(len(seg)) + np.repeat(a - (np.cumsum(lens) - lens), lens)]
        spans = np.stack([place[a] - starts[text], place[b - 1] + 1 - starts[text]], 1) if len(a) else np.zeros((0, 2), np.int64)
        return text, spans, seg, tok

    def pairs(self, seg: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment and number of each pair of known words that are neighbours."""
        w = self._of_types()[tok, 0]
        near = (seg[1:] == seg[:-1]) & (w[1:] >= 0) & (w[:-1] >= 0)
        return seg[1:][near], w[:-1][near] * max(1, len(self.lexicon.words)) + w[1:][near]

    def encode(self, texts: list[str]) -> Encoded:
        return self.encoded(*self.segments(*self.stream(texts)))

    def encoded(self, text: np.ndarray, spans: np.ndarray, seg: np.ndarray, tok: np.ndarray) -> Encoded:
        n = len(self.types)
        both = _distinct(seg * n + tok)
        type_seg, type_no = both // n, both % n
        key_seg, key = self.pairs(seg, tok)
        pairs = self.lexicon.pairs
        pair_seg = pair_col = np.zeros(0, np.int64)
        if len(pairs):
            place = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            hit = pairs[place] == key
            found = _distinct(key_seg[hit] * len(pairs) + place[hit])
            pair_seg, pair_col = found // len(pairs), found % len(pairs) + self.lexicon.first_pair
        return Encoded(text, spans, type_seg, type_no, pair_seg, pair_col, self._lists(len(text), type_seg, self._of_types()[type_no, 1]))

    @staticmethod
    def _lists(n_seg: int, seg: np.ndarray, bits: np.ndarray) -> np.ndarray:
        some = bits > 0
        seg, bits = seg[some], bits[some]
        count = {f: np.bincount(seg[(bits >> k) & 1 > 0], minlength=n_seg) for f, k in _BIT.items()}
        on = {f: c > 0 for f, c in count.items()}
        second = on["second"]
        extra = (
            on["insult"] & second, on["profanity"] & second, on["sexual"] & (on["target"] | on["group"]), on["threat"] & second, on["group"] & on["degrade"], on["profanity"] & on["technical"],
        )
        return np.stack([*on.values(), *[count[f] > 1 for f in SETS], *extra], 1) if n_seg else np.zeros((0, len(LIST_FEATURES)), bool)


class Rows(NamedTuple):
    """A sparse matrix of zeros and ones, row by row; no row is empty, as each has the bias."""

    row: np.ndarray
    col: np.ndarray
    start: np.ndarray
    width: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.col], self.start)

    def only(self, rows: np.ndarray) -> Rows:
        """The rows for which ``rows`` is true."""
        keep = rows[self.row]
        row = (np.cumsum(rows) - 1)[self.row[keep]]
        return Rows(row, self.col[keep], np.searchsorted(row, np.arange(int(rows.sum()))), self.width)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row], minlength=self.width)


def rows_of(e: Encoded, types: list[Type], width: int) -> Rows:
    n = len(e.text)
    of_type = [np.array(t.columns, np.int64) for t in types]
    sizes = np.array([len(c) for c in of_type], np.int64)
    parts = [(np.arange(n), np.zeros(n, np.int64)), tuple(np.nonzero(e.lists)), (e.pair_seg, e.pair_col)]
    parts[1] = (parts[1][0], parts[1][1] + 1)
    flat = np.concatenate(of_type) if of_type else np.zeros(0, np.int64)
    offset = np.cumsum(sizes) - sizes
    reps = sizes[e.type_no]
    nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    parts.append((np.repeat(e.type_seg, reps), flat[np.repeat(offset[e.type_no], reps) + nth] if len(nth) else np.zeros(0, np.int64)))
    row, col = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    both = _distinct(row * width + col)
    row, col = both // width, both % width
    return Rows(row, col, np.searchsorted(row, np.arange(n)), width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """Without the threads that a library would start for it."""
    return float((a * b).sum())


def _times(dense: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sum((dense[:, k] * w[k] for k in range(len(w))), np.zeros(len(dense)))


def logistic(x: Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float, steps: int = 40, begin: np.ndarray | None = None, memory: int = 8) -> np.ndarray:
    """Weights of a logistic regression with a squared penalty, none on the bias, by limited-memory quasi-Newton steps.
    ``dense`` has further columns."""
    d = x.width
    penalty = np.full(d + dense.shape[1], strength)
    penalty[0] = 1e-3

    def loss(w):
        z = np.clip(x.times(w[:d]) + _times(dense, w[d:]), -30, 30)
        p = 1 / (1 + np.exp(-z))
        r = weight * (p - y)
        value = _dot(weight, np.log1p(np.exp(z)) - y * z) + 0.5 * _dot(penalty, w * w)
        return value, np.concatenate([x.transposed(r), (dense * r[:, None]).sum(0)]) + penalty * w

    w = np.zeros(d + dense.shape[1])
    rate = float(np.clip(_dot(weight, y) / max(weight.sum(), 1e-9), 1e-6, 1 - 1e-6))
    w[0] = np.log(rate / (1 - rate))
    if begin is not None:
        w[: len(begin)] = begin
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, a = grad.copy(), []
        for s, g, rho in reversed(past):
            a.append(rho * _dot(s, q))
            q -= a[-1] * g
        q *= _dot(past[-1][0], past[-1][1]) / _dot(past[-1][1], past[-1][1]) if past else 1 / max(1.0, np.abs(grad).max())
        for (s, g, rho), k in zip(past, reversed(a)):
            q += s * (k - rho * _dot(g, q))
        slope, size = _dot(grad, q), 1.0
        while size > 1e-6:
            new = w - size * q
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, g = new - w, new_grad - grad
        if (sg := _dot(s, g)) > 1e-12:
            past = [*past, (s, g, 1 / sg)][-memory:]
        done = value - new_value < 1e-4 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w


class Chain(NamedTuple):
    words: dict
    pairs: np.ndarray
    learned: frozenset  # words that tell, which a disguise may hide
    weights: np.ndarray  # columns by categories
    links: tuple  # of each category the weights of the probabilities before it
    threshold: float

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.pairs, Known.of(self.learned))


#: Of words and pairs those that stand in at least so many labelled documents are features of their own.
LEAST = 2
#: Of so many ordinary segments without words of the lists one stands for all in the models of the categories.
ORDINARY = 8
#: Strength of the penalty, and rounds in which the sentences of toxic documents are told apart.
STRENGTH, ROUNDS, FOLDS = 0.5, 3, 3


def _telling(docs: list[set[str]], label: np.ndarray) -> tuple[dict[str, int], frozenset]:
    """Words of at least LEAST documents, and those of them that are far more common in toxic ones."""
    bad: dict[str, int] = {}
    all_: dict[str, int] = {}
    for tokens, y in zip(docs, label):
        for t in tokens:
            all_[t] = all_.get(t, 0) + 1
            if y:
                bad[t] = bad.get(t, 0) + 1
    words = sorted(t for t, n in all_.items() if n >= LEAST and t and t[0] not in "*@" and "*" not in t and t not in _ENDS and t not in _QUOTES and not t.isdigit() and not _CJK.match(t))
    n_bad, n = int(label.sum()), len(label)
    odds = lambda t: np.log((bad.get(t, 0) + 0.5) / (n_bad + 1)) - np.log((all_[t] - bad.get(t, 0) + 0.5) / (n - n_bad + 1))
    learned = frozenset(t for t in words if len(t) > 3 and t.isalpha() and bad.get(t, 0) >= 3 and odds(t) > 2)
    return {t: k for k, t in enumerate(['"', "#", "#x", "@", "*", *words])}, learned


def _folds(docs: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(d).encode()) % FOLDS for d in docs])


def _out_of_fold(x: Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, steps: int, begin: list | None = None) -> tuple[np.ndarray, list]:
    """For each row what a model says that hasn't seen its fold, and these models. ``begin`` has models that haven't seen
    the folds either."""
    out, models = np.zeros(len(y)), []
    for k in range(FOLDS):
        w = logistic(x, dense, y, weight * (fold != k), STRENGTH, steps, begin[k] if begin else None)
        out[fold == k] = (x.times(w[: x.width]) + _times(dense, w[x.width :]))[fold == k]
        models.append(w)
    return out, models


def _best_of(groups: np.ndarray, n: int, z: np.ndarray) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, groups, z)
    return out


def train(docs: list[tuple[int, int, str]]) -> Chain | None:
    """docs: doc_id, label (0 or 1), text. Labels are of documents; which sentences of a toxic document are toxic is
    inferred: at first all count a little, then those that models which haven't seen the document find most toxic. Labels
    that such models contradict strongly are left out. None without labels of both kinds."""
    docs = sorted({d[0]: d for d in docs if d[2]}.values())
    label = np.array([d[1] for d in docs], np.int64)
    if not len(docs) or not label.any() or label.all():
        return None
    none = Known.of(frozenset())
    back = lru_cache(maxsize=1 << 18)(lambda t: t if t in _ENDS else undisguise(t, none)[0])
    texts = [d[2] for d in docs]
    words, learned = _telling([set(map(back, set(tokens_of(t)))) for t in texts], label)
    known = Known.of(learned)
    encoder = Encoder(Lexicon(words, np.zeros(0, np.int64), known))
    found = encoder.segments(*encoder.stream(texts))
    pairs = _pairs(encoder, *found)
    lexicon = Lexicon(words, pairs, known)
    encoder.lexicon = lexicon
    encoder.types = [lexicon.type_of(t) if k else encoder.types[0] for k, t in enumerate(encoder.names)]  # buckets come after the pairs
    e = encoder.encoded(*found)
    x = rows_of(e, encoder.types, lexicon.width)
    of = e.text
    fold = _folds(np.array([d[0] for d in docs]))[of]
    bad = label[of] == 1
    alone = np.zeros((len(of), 0))
    y, weight = bad.astype(float), np.where(bad, 1 / np.sqrt(np.bincount(of, minlength=len(docs))[of]), 1.0)
    z, models = _out_of_fold(x, alone, y, weight, fold, 15)
    for number in range(ROUNDS):
        top = _best_of(of, len(docs), z)
        usual = np.quantile(top[(label == 0) & np.isfinite(top)], [0.5, 0.9]) if ((label == 0) & np.isfinite(top)).any() else np.array([-9.0, -9.0])
        credible = top > usual[1]
        y = (bad & credible[of] & ((z >= top[of]) | (z > 0.5))).astype(float)
        if not y.any():
            y = (bad & (z >= top[of])).astype(float)
        # what a toxic document has besides counts as ordinary if it looks so; a harmless document's sentence that looks toxic is left out
        weight = np.where(bad, (y > 0) | (z < usual[0]), z < 3.0).astype(float)
        if number < ROUNDS - 1:
            z, models = _out_of_fold(x, alone, y, weight, fold, 10, models)
    at = {f: e.lists[:, k] for k, f in enumerate(LIST_FEATURES)}
    fires = {"insult": at["insult"] | at["profanity_at"], "threat": at["threat_at"], "hate": at["group_degrade"], "sexual": at["sexual"]}
    # for the categories, ordinary segments without any word of the lists are represented by one of ORDINARY
    listed = e.lists[:, [_BIT[f] for f in SETS]].any(1) | (y > 0)
    drawn = listed | (np.arange(len(of)) % ORDINARY == 0)
    part, part_weight = x.only(drawn), (weight * np.where(listed, 1, ORDINARY))[drawn]
    probs, weights, links = np.zeros((len(of), 0)), [], []
    for c in CATEGORIES[:-1]:
        target = (y * fires[c])[drawn]
        w = logistic(part, probs[drawn], target, part_weight, STRENGTH, 20)
        weights.append(w[: x.width])
        links.append(tuple(w[x.width :]))
        _, held = _out_of_fold(part, probs[drawn], target, part_weight, fold[drawn], 12)
        z = np.zeros(len(of))
        for k, m in enumerate(held):
            z[fold == k] = (x.times(m[: x.width]) + _times(probs, m[x.width :]))[fold == k]
        probs = np.hstack([probs, _sigmoid(z)[:, None]])
    w = logistic(x, probs, y, weight, STRENGTH, 30, sum(models) / FOLDS)
    weights.append(w[: x.width])
    links.append(tuple(w[x.width :]))
    z, _ = _out_of_fold(x, probs, y, weight, fold, 15, models)
    top = _best_of(of, len(docs), _sigmoid(z))
    return Chain(words, pairs, learned, np.stack(weights, 1).astype(np.float32), tuple(links), _threshold(np.where(np.isfinite(top), top, 0.0), label))


def _pairs(encoder: Encoder, text: np.ndarray, spans: np.ndarray, seg: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """Pairs of known words in at least LEAST of the texts, in order."""
    seg, key = encoder.pairs(seg, tok)
    keys, n = np.unique(key, return_inverse=True)
    both = _distinct(text[seg] * max(1, len(keys)) + n)
    return keys[np.bincount(both % max(1, len(keys)), minlength=len(keys)) >= LEAST] if len(keys) else keys.astype(np.int64)


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The score from which documents are flagged: where F1 is within a hundredth of the best on documents that the models haven't
    seen, as near to one half as that allows and between 0.3 and 0.7."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + label.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # equal scores stand together
    good = s[f1 >= 0.99 * f1.max()]
    return float(np.clip(np.clip(0.5, good.min(), good.max()), 0.3, 0.7))


class Scorer:
    """Scores texts with a chain; without one nothing is toxic."""

    #: Characters at most that are encoded at once, unless one text has more.
    AT_ONCE = 1 << 20

    def __init__(self, chain: Chain | None):
        self.chain = chain
        if chain is not None:
            self.encoder = Encoder(chain.lexicon())
            self.of_types, self.of_clearing = np.zeros((0, len(CATEGORIES)), np.float32), 0

    def _weights(self) -> np.ndarray:
        """Of each type the sum of its columns' weights."""
        types = self.encoder.types
        if self.of_clearing != self.encoder.times_cleared:
            self.of_types, self.of_clearing = self.of_types[:0], self.encoder.times_cleared
        new = types[len(self.of_types) :]
        if new:
            sizes = np.array([len(t.columns) for t in new])
            row = np.repeat(np.arange(len(new)), sizes)
            w = self.chain.weights[np.array([c for t in new for c in t.columns], np.int64)]
            self.of_types = np.vstack([self.of_types, np.stack([np.bincount(row, weights=w[:, k], minlength=len(new)) for k in range(w.shape[1])], 1).astype(np.float32)])
        return self.of_types

    def segments(self, texts: list[str]) -> tuple[Encoded, np.ndarray]:
        """Probabilities of the categories by segment."""
        e = self.encoder.encode(texts)
        w, n = self.chain.weights, len(e.text)
        of_type, z = self._weights(), np.zeros((n, len(CATEGORIES)))
        z += w[0] + e.lists @ w[1 : 1 + len(LIST_FEATURES)]
        for k in range(len(CATEGORIES)):
            z[:, k] += np.bincount(e.type_seg, weights=of_type[e.type_no, k], minlength=n) + np.bincount(e.pair_seg, weights=w[e.pair_col, k], minlength=n)
        probs = np.zeros((n, 0))
        for k, link in enumerate(self.chain.links):
            probs = np.hstack([probs, _sigmoid(z[:, k] + probs @ np.array(link))[:, None]])
        return e, probs

    def texts(self, texts: list[str | None]) -> list[tuple[tuple, str]]:
        """Of each text the probabilities of the categories, of each its greatest over the segments, and the most toxic
        segment as it reads without disguise."""
        out: list[tuple[tuple, str]] = [(_NOTHING, "")] * len(texts)
        if self.chain is None:
            return out
        batch, size = [], 0
        for k, t in enumerate(texts):
            if t:
                batch.append(k)
                size += len(t)
            if batch and (size >= self.AT_ONCE or k == len(texts) - 1):
                self._some([texts[b] for b in batch], batch, out)
                batch, size = [], 0
        if batch:
            self._some([texts[b] for b in batch], batch, out)
        return out

    def _some(self, texts: list[str], places: list[int], out: list) -> None:
        e, probs = self.segments(texts)
        if not len(e.text):
            return
        first = np.flatnonzero(np.concatenate(([True], e.text[1:] != e.text[:-1])))
        best = np.maximum.reduceat(probs, first)
        for row, seg, end in zip(best.tolist(), first.tolist(), [*first[1:].tolist(), len(probs)]):
            t = int(e.text[seg])
            shown = ""
            if row[-1] > self.chain.threshold / 2:
                a, b = e.spans[seg + int(np.argmax(probs[seg:end, -1]))]
                shown = " ".join(tokens_of(texts[t])[a:b])
            out[places[t]] = (tuple(row), shown)

    def text(self, text: str | None) -> tuple[tuple, str]:
        return self.texts([text])[0]


_NOTHING = (0.0,) * len(CATEGORIES)
