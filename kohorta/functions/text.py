"""Column expressions over post text."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide the result. They avoid look-around, so other
# engines read them alike (possessive repeats only save the JVM going back), and repeat
# only character classes: the JVM walks a repeated group by recursion, which a long text
# can exhaust.
BLANK = r"[\t-\r \x1c-\x1f\x85\p{Z}]"
NON_BLANK = r"[^\t-\r \x1c-\x1f\x85\p{Z}]"
# What makes a text other than words with one space between them.
UNEVEN = BLANK + r"{2,}|[\t-\r\x1c-\x1f\x85\p{Z}&&[^ ]]"
MENTION = r"@[\p{L}\p{N}_]+"
POST_TOKEN = (
    r"https?://\S+|www\.\S+"  # link
    r"|(?:\+?[01][ *.)-]*)?(?:\(?\p{Nd}{3}[ *.)-]*)?\p{Nd}{3}[ *.)-]*\p{Nd}{4}"  # telephone number
    r"|[<>]?[:;=8][-o*']?[)\](\[dDpP/:}{@|\\]"  # emoticon
    r"|[)\](\[dDpP/:}{@|\\][-o*']?[:;=8][<>]?|</?3"  # mirrored emoticon, heart
    r"|<[^>\s]++>"  # tag
    r"|-++>|<-+"  # arrow
    r"|@[\p{L}\p{N}_]+"  # mention
    r"|#+[\p{L}\p{N}_]+[\p{L}\p{N}_'-]*[\p{L}\p{N}_]+"  # hashtag
    r"|[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]++\.[\p{L}\p{N}_.-]*[\p{L}\p{N}_]"  # e-mail address
    r"|\p{L}[\p{L}'_-]+\p{L}"  # word with inner apostrophe or hyphen
    r"|[+-]?\p{N}+[,/.:-]\p{N}+[+-]?"  # fraction, decimal, time
    r"|[\p{L}\p{N}_]+"  # any other word
    r"|\.[\s.]*\."  # dots
    r"|\S"  # single sign
)
# Words of letters before a blank or a sign that no longer token goes on with: tokens by
# themselves, so a row of them with single spaces is one match instead of many. The JVM
# repeats a possessive group in a loop.
PLAIN_WORDS = r"\p{L}++(?=[\s,!?])(?: \p{L}++(?=[\s,!?]))*+"
# Character references that post text carries, in the order of decoding.
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
WORD_OR_GAP = r"\p{L}(?:[\p{L}'’]*\p{L})?|[^\p{L}]+"

# Parts a text for one step; a text that holds it takes another way.
MARK = "\x01"

# Literal replacements on the joined tokens, applied in this order.
TOKEN_REWRITES = [
    ("cannot ", "can not "),
    ("n't ", " n't "),
    ("n 't ", " n't "),
    ("ca n't", "can't"),
    ("ai n't", "ain't"),
    ("'m ", " 'm "),
    ("'re ", " 're "),
    ("'s ", " 's "),
    ("'ll ", " 'll "),
    ("'d ", " 'd "),
    ("'ve ", " 've "),
    (" p . m .", "  p.m."),
    (" p . m ", " p.m "),
    (" a . m .", " a.m."),
    (" a . m ", " a.m "),
]

# What a text must hold for a pair of TOKEN_REWRITES to match.
REWRITE_SIGNS = ["'", "cannot ", " . m"]

# Number patterns that the tokeniser pulled apart.
NUMBER_REWRITES = [
    (r",([0-9]{2,4}) , ([0-9]{2,4})", r",$1,$2"),
    (r"([0-9]{1,3}) / ([0-9]{2,4})", r"$1/$2"),
    (r"([0-9]{1,3})- ([0-9]{2,4})", r"$1-$2"),
]
# What a text must hold for a pattern of NUMBER_REWRITES to match.
NUMBER_SIGNS = [" , ", " / ", "- "]

# Contracted form to full form, lower case.
CONTRACTIONS = {
    "ain't": "are not", "aren't": "are not", "can't": "cannot", "could've": "could have",
    "couldn't": "could not", "daren't": "dare not", "didn't": "did not",
    "doesn't": "does not", "don't": "do not", "hadn't": "had not", "hasn't": "has not",
    "haven't": "have not", "he'd": "he would", "he'll": "he will", "he's": "he is",
    "how'd": "how did", "how'll": "how will", "how're": "how are", "how's": "how is",
    "i'd": "I would", "i'll": "I will", "i'm": "I am", "i've": "I have",
    "isn't": "is not", "it'd": "it would", "it'll": "it will", "it's": "it is",
    "let's": "let us", "ma'am": "madam", "mayn't": "may not", "might've": "might have",
    "mightn't": "might not", "must've": "must have", "mustn't": "must not",
    "needn't": "need not", "o'clock": "of the clock", "oughtn't": "ought not",
    "shan't": "shall not", "she'd": "she would", "she'll": "she will", "she's": "she is",
    "should've": "should have", "shouldn't": "should not", "so's": "so is",
    "somebody's": "somebody is", "someone's": "someone is", "something's": "something is",
    "that'd": "that would", "that'll": "that will", "that's": "that is",
    "there'd": "there would", "there'll": "there will", "there're": "there are",
    "there's": "there is", "these're": "these are", "they'd": "they would",
    "they'll": "they will", "they're": "they are", "they've": "they have",
    "this'll": "this will", "this's": "this is", "those're": "those are",
    "wasn't": "was not", "we'd": "we would", "we'll": "we will", "we're": "we are",
    "we've": "we have", "weren't": "were not", "what'd": "what did",
    "what'll": "what will", "what're": "what are", "what's": "what is",
    "what've": "what have", "when's": "when is", "where'd": "where did",
    "where's": "where is", "where've": "where have", "who'd": "who would",
    "who'll": "who will", "who're": "who are", "who's": "who is", "who've": "who have",
    "why'd": "why did", "why're": "why are", "why's": "why is", "won't": "will not",
    "would've": "would have", "wouldn't": "would not", "y'all": "you all",
    "you'd": "you would", "you'll": "you will", "you're": "you are", "you've": "you have",
    "dunno": "do not know", "gimme": "give me", "gonna": "going to", "gotta": "got to",
    "lemme": "let me", "wanna": "want to",
}

# Names that differ from the character's Unicode name.
EMOJI_NAMES = {
    "❤": "red_heart",
    "©": "copyright",
    "®": "registered",
    "™": "trade_mark",
    "☀": "sun",
    "☁": "cloud",
    "✅": "check_mark_button",
    "✔": "check_mark",
    "❌": "cross_mark",
    "✨": "sparkles",
    "⭐": "star",
    "\U0001f44d": "thumbs_up",
    "\U0001f44e": "thumbs_down",
    "\U0001f44f": "clapping_hands",
    "\U0001f64f": "folded_hands",
    "\U0001f602": "face_with_tears_of_joy",
    "\U0001f62d": "loudly_crying_face",
    "\U0001f60d": "smiling_face_with_heart-eyes",
    "\U0001f622": "crying_face",
    "\U0001f621": "enraged_face",
    "\U0001f620": "angry_face",
    "\U0001f4aa": "flexed_biceps",
    "\U0001f525": "fire",
    "\U0001f489": "syringe",
    "\U0001f48a": "pill",
}
# Blocks whose characters take their Unicode name as emoji name.
EMOJI_BLOCKS = [(0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF)]
# Where a sign may have a name; those without one stay as they are.
HIGH_SIGN = r"[\x{A9}\x{AE}\x{203C}-\x{1FAFF}]"
# One class stands first in these, as the JVM tries whole alternatives at every character.
RARE_SIGN = r"[\x{A9}\x{AE}\x{203C}-\x{1FAFF}\t-\r\x1c-\x1f\x85\p{Z}&&[^ ]]"
LINK_START = r"[HhWw](?i:ttp|ww)"
LINK_OR_NUMBER = r"[HhWw,](?i:ttp|ww|[0-9]{2,4} , [0-9])"
EMOJI_CLASS = (
    r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}"
    r"\x{25AA}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}"
    r"\x{1F004}-\x{1F251}\x{1F300}-\x{1FAFF}]"
)


def emoji_names(extra: dict[str, str] | None = None) -> dict[str, str]:
    """Emoji character to ``:name:``, from Unicode names plus the fixed exceptions.

    ``extra`` goes before both, such as the names of ``sources.emoji.read_emoji_names``.
    """
    names = {}
    for low, high in EMOJI_BLOCKS:
        for point in range(low, high + 1):
            name = unicodedata.name(chr(point), None)
            if name:
                names[chr(point)] = name.lower().replace(" ", "_")
    names.update(EMOJI_NAMES)
    names.update(extra or {})
    return {char: f":{name}:" for char, name in names.items()}


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def change_if(value: Column, test, change) -> Column:
    """``change(value)`` where ``test(value)``, which costs less than the change, holds."""
    return bind(value, lambda v: F.when(test(v), change(v)).otherwise(v))


def _map_literal(mapping: dict[str, str]) -> Column:
    # Folded to one constant at planning time: a single literal instead of
    # thousands of map arguments.
    return F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")


def full_text(text: Column, full: Column | None = None, extended: Column | None = None) -> Column:
    """Longest known form of a post: extended text, then full text, then text."""
    return F.coalesce(*[c for c in (extended, full, text) if c is not None])


def cut_at_url(text: Column) -> Column:
    """Everything before the first ``https://``; plain ``http://`` stays."""
    return F.substring_index(text, "https://", 1)


def strip_mentions(text: Column) -> Column:
    return F.regexp_replace(text, MENTION, "")


def is_repost(text: Column) -> Column:
    return text.startswith("RT @")


def token_count(text: Column) -> Column:
    """Number of blank-separated pieces, Unicode blanks included."""
    return F.regexp_count(text, F.lit(NON_BLANK + "+"))


def has_more_tokens(text: Column, n: int) -> Column:
    """Whether a text has more than ``n`` blank-separated pieces; reads no farther than those."""
    if not 0 <= n <= 200:
        return token_count(text) > n
    return text.rlike(f"^{BLANK}*+" + f"{NON_BLANK}++{BLANK}++" * n + NON_BLANK)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, UNEVEN, " "))


def has_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """Case-sensitive substring test against any keyword."""
    hit = F.lit(False)
    for word in keywords:
        hit = hit | text.contains(word)
    return hit


def matches_track(text: Column, keywords: Iterable[str]) -> Column:
    """Case-insensitive test against any track keyword."""
    words = [w for w in keywords if w]
    if not words:
        return F.lit(False)
    # \Q..\E would end early on a keyword holding \E, so every sign is escaped.
    pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
    return text.rlike("(?iu)" + pattern)


def expand_contractions(text: Column, table: dict[str, str] | None = None) -> Column:
    """Replace contracted words, keeping a leading capital.

    Only words in the table change; all other characters stay as they are. Texts
    with neither an apostrophe nor a listed word without one skip the work.
    """
    table = CONTRACTIONS if table is None else table
    lookup = _map_literal(table)
    keys = list(table)

    def expand(piece):
        word = F.lower(F.translate(piece, "’", "'"))
        full = F.element_at(lookup, word)
        first = F.substring(piece, 1, 1)
        raised = F.concat(F.upper(F.substring(full, 1, 1)), full.substr(F.lit(2), F.length(full)))
        return (
            F.when(~word.isin(keys), piece)
            .when(first != F.lower(first), raised)
            .otherwise(full)
        )

    # Keys without an apostrophe, by classes of their first letters: lets more through, never less.
    bare = [key for key in keys if "'" not in key]
    if all(re.fullmatch("[a-z]+", key) for key in bare):
        other = {"i": "İ", "k": "\u212a"}
        columns = [sorted(set(c)) for c in zip(*bare, strict=False)]
        bare_word = "".join(f"[{''.join(c + c.upper() + other.get(c, '') for c in column)}]" for column in columns)
    else:
        bare_word = "(?iu)" + "|".join(map(re.escape, bare))

    def has_apostrophe(t):
        return t.contains("'") | t.contains("’")

    def has_bare(t):
        return t.rlike(bare_word) if bare else F.lit(False)

    def expand_words(part):
        pieces = F.regexp_extract_all(part, F.lit(WORD_OR_GAP), F.lit(0))
        return F.array_join(F.transform(pieces, expand), "")

    def where(test, joint):
        def body(part):
            return F.when(test(part), expand_words(part)).otherwise(part)

        return lambda parts: F.array_join(F.transform(parts, body), joint)

    def ends_marked(part):
        head, tail = F.substring_index(part, " ", 1), F.substring_index(part, " ", -1)
        inner = part.substr(F.length(head) + 1, F.length(part) - F.length(head) - F.length(tail))
        return F.when(part.contains(" "), F.concat(head, F.lit(MARK), inner, F.lit(MARK), tail)).otherwise(part)

    # No word holds a space, so what lies between spaces is looked at by itself. Where only
    # apostrophes count, the text is cut there, marks are put at the first and last space of
    # each part, and what lies between two marks and holds an apostrophe is looked at.
    every = where(lambda part: has_apostrophe(part) | has_bare(part), " ")(F.split(text, " "))
    cut = text
    for sign in "'’":
        cut = F.replace(cut, F.lit(sign), F.lit(MARK + sign))
    marked = F.array_join(F.transform(F.split(cut, MARK), ends_marked), "")
    few = where(has_apostrophe, "")(F.split(marked, MARK))
    return (
        F.when(has_bare(text) | (text.contains(MARK) & has_apostrophe(text)), every)
        .when(has_apostrophe(text), few)
        .otherwise(text)
    )


def unescape(text: Column) -> Column:
    """Character references of post text decoded."""

    def decode(t):
        for reference, sign in REFERENCES:
            t = F.replace(t, F.lit(reference), F.lit(sign))
        return t

    return change_if(text, lambda t: t.contains("&"), decode)


def tokenize_post(text: Column) -> Column:
    """Links, telephone numbers, emoticons, tags, arrows, mentions, hashtags, addresses, words and signs."""
    return F.regexp_extract_all(unescape(text), F.lit(POST_TOKEN), F.lit(0))


def normalize_token(token: Column, names: Column | None = None) -> Column:
    """Mention to ``@USER``, link to ``HTTPURL``, emoji to its name, quotes to ASCII."""
    names = _map_literal(emoji_names()) if names is None else names
    return (
        F.when(token.startswith("@"), "@USER")
        .when(F.lower(token).rlike("^(http|www)"), "HTTPURL")
        .when(
            (F.length(token) == 1) & token.rlike(EMOJI_CLASS),
            F.coalesce(F.element_at(names, token), token),
        )
        .when(token == "’", "'")
        .when(token == "…", "...")
        .otherwise(token)
    )


def normalize_post(text: Column, extra_emoji: dict[str, str] | None = None) -> Column:
    """Tokenise, normalise each token, join by blanks and mend what was split.

    Tokens cover every non-blank character, so putting one blank behind each match, in place
    of those that follow it, equals joining the token list; only texts with an emoji go
    through the list.
    """
    plain = F.replace(
        F.replace(unescape(text), F.lit("’"), F.lit("'")), F.lit("…"), F.lit("...")
    )
    spaced = F.regexp_replace(plain, rf"({PLAIN_WORDS}|{POST_TOKEN})\s*", "$1 ")
    names = _map_literal(emoji_names(extra_emoji))
    return change_if(F.trim(spaced), may_need_mending, lambda line: _mended(line, names))


def may_need_mending(line: Column) -> Column:
    """False only where no step of ``_mended`` changes the joined tokens."""
    hit = line.rlike(RARE_SIGN) | line.rlike(LINK_OR_NUMBER)
    for sign in ["@", "  ", *REWRITE_SIGNS, *NUMBER_SIGNS[1:]]:
        hit = line.contains(sign) | hit
    return hit


def _mended(joined: Column, names: Column) -> Column:
    """Joined tokens with single blanks, signs named and what was split put together again."""
    joined = F.trim(F.regexp_replace(joined, r"\s{2,}|[\t-\r]", " "))
    joined = change_if(
        joined, lambda line: line.contains("@"), lambda line: F.regexp_replace(line, r"(^| )@[^ ]*", "$1@USER")
    )
    joined = change_if(
        joined,
        lambda line: line.rlike(LINK_START),
        lambda line: F.regexp_replace(line, r"(?i)(^| )(?:http|www)[^ ]*", "$1HTTPURL"),
    )

    def named(token):
        return F.when(
            token.rlike("^" + EMOJI_CLASS + "$"), F.coalesce(F.element_at(names, token), token)
        ).otherwise(token)

    joined = change_if(
        joined,
        lambda line: line.rlike(HIGH_SIGN),
        lambda line: F.array_join(F.transform(F.split(line, " "), named), " "),
    )
    for sign, rewrites in groupby(TOKEN_REWRITES, lambda pair: next(s for s in REWRITE_SIGNS if s in pair[0])):

        def rewrite(line, rewrites=list(rewrites)):
            for old, new in rewrites:
                line = F.replace(line, F.lit(old), F.lit(new))
            return line

        joined = change_if(joined, lambda line, sign=sign: line.contains(sign), rewrite)
    for (pattern, new), sign in zip(NUMBER_REWRITES, NUMBER_SIGNS, strict=True):
        joined = change_if(
            joined,
            lambda line, sign=sign: line.contains(sign),
            lambda line, pattern=pattern, new=new: F.regexp_replace(line, pattern, new),
        )
    return squeeze(joined)
