from pyspark.sql import functions as F

from reelloom.functions import names, scalars
from reelloom.functions.infohash import hash_of_delivery, normalize_info_hash
from reelloom.operators import fulltext


def one(spark, text, make, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def test_hashes(spark):
    plain = "0123456789abcdef0123456789abcdef01234567"
    import base64

    b32 = base64.b32encode(bytes.fromhex(plain)).decode()
    for text in (plain, plain.upper(), f"\t{plain}\n", b32, b32.lower(), f" {b32} "):
        assert one(spark, text, normalize_info_hash) == plain
        assert one(spark, f"magnet:?dn=x&xt=urn:btih:{text.strip()}&tr=y", hash_of_delivery) == plain
    for text in ("", None, plain[:-1], plain + "0", "g" * 40, b32[:-1] + "1", "magnet:?dn=x", "magnet:?xt=urn:sha1:" + plain):
        assert one(spark, text, hash_of_delivery) is None


def test_release_names(spark):
    cases = {
        "Tuner.2025.1080p.WEB-DL.mkv": ("movie", "Tuner", 2025),
        "[SubsPlease] Rurouni Kenshin (2023) - 43 (1080p).mkv": ("tv_show", "Rurouni Kenshin", 2023),
        "2012.2009.1080p.mkv": ("movie", None, 2012),
        "Show.S01E02.720p": ("tv_show", "Show", None),
        "Some.Film.1080p": ("movie", "Some Film", None),
        "Some_Film_1080p": ("movie", "Some Film 1080p", None),
        "ab": ("movie", None, None),
        "[] Plain name": ("movie", "Plain name", None),
        "": ("movie", None, None),
    }
    for text, expected in cases.items():
        assert tuple(one(spark, text, names.parse_release_name)) == expected, text


def test_titles(spark):
    assert one(spark, "かぐや様 2026!", names.normalized_title) == "かぐや様2026"
    assert one(spark, "ÉTÉ Ab-C", names.normalized_title) == "ÉtÉabc"
    pairs = [("Matrix", "matrix", True), ("Matrix", "The Matrix", False), ("Long Title", "A Long Title Here", True), ("", "x", False)]
    df = spark.createDataFrame(pairs, "a string, b string, c boolean").select("c", names.titles_match(F.col("a"), F.col("b")).alias("m"))
    assert all(r.c == r.m for r in df.collect())


def test_scalars(spark):
    assert one(spark, "tt14688458", scalars.is_imdb_id) and not one(spark, "tt12x45", scalars.is_imdb_id) and not one(spark, None, scalars.is_imdb_id)
    assert tuple(one(spark, "Show.S02E07.mkv", scalars.episode_of_path)) == (2, 7)
    assert tuple(one(spark, "Show 3x11.mp4", scalars.episode_of_path)) == (3, 11)
    assert tuple(one(spark, "1920x1080", scalars.episode_of_path)) == (920, 108)
    assert one(spark, "Show Season 2.mkv", scalars.episode_of_path) is None
    assert one(spark, "x 1080P y", scalars.video_resolution) == "V1080p" and one(spark, "none", scalars.video_resolution) is None
    assert one(spark, "V", scalars.normalized_quality) == "unknown" and one(spark, "V720P", scalars.normalized_quality) == "720p"
    assert one(spark, " Sci-Fi & More ", scalars.genre_slug) == "sci-fi--more"
    assert one(spark, "the-great-escape", scalars.title_of_slug) == "The Great Escape"
    assert one(spark, "2.5 GB of 3 GiB", scalars.page_size_bytes) == 2_500_000_000
    assert one(spark, "99999999999 TiB", scalars.page_size_bytes) is None
    assert one(spark, "/a.jpg", lambda c: scalars.image_url("http://b", c)) == "http://b/a.jpg"
    assert one(spark, " ", lambda c: scalars.image_url("http://b", c)) is None
    assert one(spark, "https://c/a", lambda c: scalars.image_url("http://b", c)) == "https://c/a"
    assert [one(spark, x, scalars.clamp_rating, "double") for x in (None, -1.0, 11.0, float("nan"), 5.5)] == [0.0, 0.0, 10.0, 0.0, 5.5]
    assert one(spark, 2**40, scalars.saturated, "bigint") == 2**31 - 1
    assert [one(spark, x, scalars.parse_boolean) for x in (" Yes", "0", "perhaps")] == [True, False, None]
    assert one(spark, "  a \n b  c ", scalars.folded_query) == "a b c" and one(spark, "ab", scalars.folded_query) is None
    pick = lambda c: scalars.chosen_sources(F.split(c, ","), ["a", "b", "c"])
    assert one(spark, "b,a,b", pick) == ["b", "a"] and one(spark, "", pick) == ["a", "b", "c"] and one(spark, "a,z", pick) is None


def test_ratings_of_json(spark):
    cases = {"7.5": 7.5, '"8"': 8.0, '{"percentage": 74}': 7.4, '{"rating": 12}': 10.0, '"x"': None, "null": None}
    for text, expected in cases.items():
        assert one(spark, text, lambda c: scalars.rating_of_json(F.parse_json(c))) == expected, text


def test_keyword_search(spark):
    cases = [
        ("fat cat", "fat", True), ("fat cat", "fat rat", False), ("fat cat", "fat or rat", True), ("fat cat", "-cat fat", False), ("fat cat", '"cat fat"', False),
        ("the fat cat", '"fat cat" the', True), ("fat cat", "", False), (None, "fat", False), ("Fat-Cat!", "CAT", True), ("cat", "rat or fat cat", False),
    ]
    for title, query, expected in cases:
        assert one(spark, title, lambda c: fulltext.matches(fulltext.tokens(c), query)) is expected, (title, query)
