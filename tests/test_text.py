import pytest
from pyspark.sql import functions as F

from kohorta.functions import text as T


def test_cut_at_url(values):
    posts = [
        "see http://a.b now",
        "one https://a.b two https://c.d",
        "https://a.b",
        "line https://a.b\nnext line",
        None,
    ]
    assert values(T.cut_at_url, posts) == ["see http://a.b now", "one ", "", "line ", None]


def test_strip_mentions(values):
    posts = ["hi @élan_1!", "mail a@b.com", "lone @ sign", "@a@b"]
    assert values(T.strip_mentions, posts) == ["hi !", "mail a.com", "lone @ sign", ""]


def test_repost_needs_the_exact_prefix(values):
    assert values(T.is_repost, ["RT @x", "RT x", " RT @x"]) == [True, False, False]


def test_token_count_treats_every_blank_alike(values):
    posts = ["a b\tc  d", "  ", "", "a b c\x1fd", "one"]
    assert values(T.token_count, posts) == [len(p.split()) for p in posts] == [4, 0, 0, 4, 1]


def test_keyword_is_case_sensitive_inside_words(values):
    found = values(lambda c: T.has_keyword(c, ["t1d", "type 1"]), ["myt1dlife", "T1D", "type 1"])
    assert found == [True, False, True]
    assert values(lambda c: T.has_keyword(c, []), ["x"]) == [False]


def test_track_ignores_case_and_quotes_signs(values):
    found = values(lambda c: T.matches_track(c, ["#t1d", "c++", "a.b"]), ["#T1D!", "C++", "axb", None])
    assert found == [True, True, False, None]
    assert values(lambda c: T.matches_track(c, []), ["x"]) == [False]


@pytest.mark.parametrize(
    "post, expected",
    [
        ("I can't, he won’t", "I cannot, he will not"),
        ("Don't! 'can't'", "Do not! 'cannot'"),
        ("I'm i'm It's", "I am I am It is"),
        ("rock'n'roll and O'Neil", "rock'n'roll and O'Neil"),
        ("l’été d'or", "l’été d'or"),
        ("Gonna go, wanna2 see", "Going to go, want to2 see"),
        ("nothing here", "nothing here"),
        (None, None),
    ],
)
def test_expand_contractions(values, post, expected):
    assert values(T.expand_contractions, [post]) == [expected]


def test_own_contraction_table(values):
    own = {"ppl": "people"}
    assert values(lambda c: T.expand_contractions(c, own), ["I'm Ppl", "x"]) == ["I'm People", "x"]


def test_tokenize_post(values):
    posts = ["@bob I can't... go to https://x.y/z?a=1 #t1d :-) 10:30 well-known 3,5 a_b"]
    assert values(T.tokenize_post, posts) == [
        ["@bob", "I", "can't", "...", "go", "to", "https://x.y/z?a=1", "#t1d", ":-)", "10:30",
         "well-known", "3,5", "a_b"]
    ]


def test_tokenize_what_posts_draw(values):
    got = values(T.tokenize_post, [
        "a -> b <-- c <b>now</b> (: D-8> </3 <3 #covid-19's #a",
        "+1 (555) 123-4567, 555 1234 12345678 2019 100",
        "me@b.org @me a@b @8ball",
    ])
    assert got == [
        ["a", "->", "b", "<--", "c", "<b>", "now", "</b>", "(:", "D-8>", "</3", "<3", "#covid-19's", "#", "a"],
        ["+1 (555) 123-4567", ",", "555 1234", "12345678", "2019", "100"],
        ["me@b.org", "@me", "a", "@b", "@8", "ball"],
    ]


def test_emoji_names_of_a_table(spark, values, tmp_path):
    from kohorta.sources.emoji import read_emoji_names

    lines = [
        "# group: Smileys & Emotion",
        "1F600 ; fully-qualified # 😀 E1.0 grinning face",
        "2764 FE0F ; fully-qualified # ❤️ E0.6 red heart",
        "2764 ; unqualified # ❤ E0.6 red heart",
        "1F251 ; fully-qualified # 🉑 E0.6 Japanese “acceptable” button",
        "23F0 ; fully-qualified # ⏰ E0.6 alarm clock",
        "1F44D 1F3FB ; fully-qualified # 👍🏻 E1.0 thumbs up: light skin tone",
        "1FAE0 ; fully-qualified # 🫠 E14.0 melting face",
    ]
    (tmp_path / "emoji-test.txt").write_text("\n".join(lines))
    names = read_emoji_names(spark, f"{tmp_path}/emoji-test.txt", version=13.0)
    assert names == {"😀": "grinning_face", "❤": "red_heart", "🉑": "Japanese_acceptable_button", "⏰": "alarm_clock"}
    assert values(lambda c: T.normalize_post(c, names), ["at ⏰ 🉑 x"]) == ["at :alarm_clock: :Japanese_acceptable_button: x"]
    assert values(T.normalize_post, ["at ⏰ 🉑 x"]) == ["at ⏰ 🉑 x"]
    assert "🫠" in read_emoji_names(spark, f"{tmp_path}/emoji-test.txt")


def test_normalize_token(values):
    tokens = ["@bob", "@", "HTTPS://x", "wwwhat", "😀", "❤", "x", "’", "…", "…x", "word"]
    assert values(lambda c: T.normalize_token(c), tokens) == [
        "@USER", "@USER", "HTTPURL", "HTTPURL", ":grinning_face:", ":red_heart:", "x", "'", "...",
        "…x", "word",
    ]


@pytest.mark.parametrize(
    "post, expected",
    [
        ("@bob  see www.a.b", "@USER see HTTPURL"),
        ("we cannot go", "we can not go"),
        ("they're here and I'm not", "they 're here and I 'm not"),
        ("I don't know", "I do n't know"),
        ("I can't know it", "I can't know it"),
        ("at 5 p.m. sharp", "at 5 p.m. sharp"),
        ("at 5 a.m. sharp", "at 5 a.m. sharp"),
        ("10 / 2000", "10/2000"),
        ("10- 2000", "10 - 2000"),
        ("1/10- 2000", "1/10-2000"),
        ("good 😀 day", "good :grinning_face: day"),
        ("wait… what’s up", "wait ... what 's up"),
    ],
)
def test_normalize_post(values, post, expected):
    assert values(T.normalize_post, [post]) == [expected]


def test_normalize_post_equals_the_token_route(spark, small):
    """Joining normalised tokens by blanks gives the same text on whole documents."""
    from kohorta.plans import inputs as I

    plain = F.replace(F.replace(F.col("text"), F.lit("’"), F.lit("'")), F.lit("…"), F.lit("..."))
    names = T._map_literal(T.emoji_names())
    line = F.array_join(
        F.transform(T.tokenize_post(plain), lambda t: T.normalize_token(t, names)), " "
    )
    for old, new in T.TOKEN_REWRITES:
        line = F.replace(line, F.lit(old), F.lit(new))
    for pattern, new in T.NUMBER_REWRITES:
        line = F.regexp_replace(line, pattern, new)
    both = I.decorated(spark, small).select(
        T.normalize_post(F.col("text")).alias("a"), T.squeeze(line).alias("b")
    )
    assert both.filter("a <> b").count() == 0


def test_long_runs_do_not_exhaust_the_stack(values):
    posts = ["." * 100_000, "a'" * 50_000 + "a", "😀" * 20_000]
    assert values(lambda c: F.length(T.normalize_post(c)), posts)[0] == 100_000
    assert values(lambda c: F.length(T.expand_contractions(c)), posts) == [100_000, 100_001, 20_000]
    assert values(lambda c: F.size(T.tokenize_post(c)), posts) == [1, 1, 20_000]


def test_long_full_form_is_whole(values):
    full = "very " * 60 + "long"
    got = values(lambda x: T.expand_contractions(x, {"vl": full}), ["vl", "Vl"])
    assert got == [full, "V" + full[1:]]


def test_has_more_tokens_agrees_with_the_count_and_reads_no_farther(values):
    texts = [None, "", "  ", "a", " a ", "a b", "\u00a0a\u2003b\x1cc\n", "a\x85b c", "x" * 300_000, "w " * 300_000, "é 日 \U0001f600 z"]
    for n in (0, 1, 2, 3, 7, 201):
        counts = values(T.token_count, texts)
        assert values(lambda x, n=n: T.has_more_tokens(x, n), texts) == [None if c is None else c > n for c in counts]
    assert "regexp_count" not in str(T.has_more_tokens(T.F.col("x"), 7))


def test_expand_contractions_part_by_part_equals_word_by_word(values):
    """What lies between spaces is looked at alone, with the result of one pass over all words."""
    import re

    def plain(text):
        def one(m):
            full = T.CONTRACTIONS.get(m[0].lower().replace("’", "'"))
            return m[0] if full is None else full[0].upper() + full[1:] if m[0][0] != m[0][0].lower() else full

        return re.sub(r"[a-zA-Zé](?:[a-zA-Zé'’]*[a-zA-Zé])?", one, text)

    texts = ["", " ", "  I'm  here ", "(Don’t)you'd\tgonna", "x'I'll 'tis can't'", "GONNA,wanna é'd dunnoo", "\nWe're\u00a0they've ' ’ ''", "y'all's ain't "]
    assert values(T.expand_contractions, texts) == [plain(t) for t in texts]
    assert "split" in str(T.expand_contractions(T.F.col("x")))


def test_expand_contractions_round_the_marks_of_its_steps(values):
    texts = [f"I'm{T.MARK}can't", f"a{T.MARK}b", f"it's {T.MARK} gonna", "'", "a 'b", "rock'n'roll can't won’t", "don't", "winner gonna", "x  I'm  "]
    assert values(T.expand_contractions, texts) == [
        f"I am{T.MARK}cannot", f"a{T.MARK}b", f"it is {T.MARK} going to", "'", "a 'b", "rock'n'roll cannot will not", "do not",
        "winner going to", "x  I am  ",
    ]


def test_plain_words_are_one_match_and_need_no_mending(spark, values):
    plain = "Words of letters, naïve ones too! go on"
    matches = values(lambda t: F.regexp_count(t, F.lit(rf"({T.PLAIN_WORDS}|{T.POST_TOKEN})\s*")), [plain])
    assert matches == [len(["Words of letters", ",", "naïve ones too", "!", "go", "on"])]
    assert values(T.may_need_mending, ["Words of letters , naïve ones too ! go on"]) == [False]


@pytest.mark.parametrize(
    "line",
    ["a  b", "a\tb", "a\u2003b", "\u00a9", "\u2764", "@x", "see HTTP x", "wwW.x", ",12 , 345", "1 / 20", "3- 44",
     *[f"x{old}y" for old, _ in T.TOKEN_REWRITES]],
)
def test_every_step_of_mending_is_foreseen(values, line):
    assert values(T.may_need_mending, [line]) == [True]


def test_normalize_post_keeps_blanks_inside_tokens_single(values):
    posts = ["\n\t call 555  1234 now", ". \t . .  x", "do: www, d8 words,", "tab\tand\u00a0both \u2003 x", " ", None]
    assert values(T.normalize_post, posts) == [
        "call 555 1234 now", ". . . x", "do: HTTPURL , d8 words ,", "tab and both x", "", None
    ]
