"""Rule content. A combo is a tuple of items that must all hold: text to find, ``~text`` that
must be absent, or ``re:pattern``. Replace any of these lists to change the cascade."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: author names, look-alike glyphs allowed ---
AUTHOR_SCAM_PHRASES = (
    "pinnedby", "pinned by", "on telegram", "via telegram", "on instagram", r"\bon ig\b",
    r"\bvia ig\b", "check my cha", "see my cha", "visit my cha", "instagram:", "on insta",
    "on insta gram", "via instagram", "sub4sub", "sub 4 sub", "on my cha", "go to my cha",
    "im legit subbing", "im subbing", "im subbbingfree gift", "dont read my", "dont read pro",
    "dont look my", "dont look at my", "agmail.com", "f**ck", "tap me", "onlive", "atelegram",
    "telegram me", "࿕", "࿖", "check out my", "on my profile", "whatsapp me", "oninstagram",
    "viainsta", "viatelegram", "en telegram", "on facebook", "via gmail", "viagmail", "text me on",
)

AUTHOR_NO_VIDEO_PHRASES = ("with o vid", "with no vid", "without any vid")

AUTHOR_AD_PHRASES = (
    "check my profil", "open my profil", "see my profil", "check my video", "check profil",
    "check video", "tap on my", "on my picture", "tap my", "my profile",
)

# --- Fixed values: comment text, look-alike glyphs allowed ---
TEXT_SCAM_PHRASES = ("niece is burning", "because my content is", "dad is burning")

# --- Fixed values: each letter may be followed by its own run of one filler letter.
# Normalised text is lower case, so only the lower-case fillers can occur. ---
TEXT_FILLED_PHRASES = (
    "o(d{5})?mg, exa(b{4})?ct(p{7})?l(q{5})?y(p{7})? wh(a{8})?at(v{6})? i(w{8})? "
    "ne(m{7})?ede(q{6})?d(h{8})?",
    "o(q{8})?mg, e(s{7})?xa(v{8})?c(j{7})?t(h{6})?l(b{6})?y w(l{4})?h(i{6})?at "
    "y(h{8})?o(u{4})?u(i{7})? n(g{8})?e(p{4})?e(c{7})?d(q{4})?e(s{4})?d(z{4})?",
    "om(i{4})?g(e{4})?, e(i{6})?xa(k{7})?c(l{6})?tl(e{7})?y w(j{7})?ha(p{7})?t(y{6})? "
    "p(c{5})?eople(f{7})? ne(v{8})?ede(m{4})?d",
    'm(l{7})?e(q{6})?g(w{4})?an(t{5})?: "ho(f{8})?t(p{4})?t(k{5})?er(l{8})?"',
    'g(d{7})?a(h{6})?ze(e{5})?: "a(f{5})?ma(q{7})?z(d{6})?ed"',
    "is(x{7})? tr(m{7})?a(l{6})?s(v{5})?h(p{5})?, my co(i{6})?n(c{7})?tent(r{7})? is",
    "is(z{8})? garba(l{5})?g(v{6})?e(p{6})?, my(u{4})? conte(h{6})?n(f{6})?t i(s{7})?s",
    "o(i{5})?n(v{5})? !g(t{4})?",
)

# --- Fixed values: combos on the normalised author name ---
AUTHOR_COMBOS = (
    ("what", "app", "~appen", "~status"),
    ("message", "instagram"),
    ("telegram", "@"),
    ("tele", "gram"),
    ("nice", "gram"),
    ("instagram", "@"),
    ("message", "@"),
    ("text", "@"),
    (":point_left:", "@"),
    (":point_right:", "@"),
    ("message", ":point_right:"),
    ("message", ":point_left:"),
    ("text", ":point_right:"),
    ("text", ":point_left:"),
    ("dm", ":point_right:"),
    ("dm", ":point_left:"),
    ("instagram", ":point_right:"),
    ("instagram", ":point_left:"),
    ("text", "on", "instagram"),
    ("hack", "on", "tele"),
    ("on", "telegram"),
    ("search", "on", "tele"),
    ("visit", ":arrow_forward:", "com"),
    ("visit", ":play_button:", "com"),
    ("contact", "com"),
    ("google", "search", "com"),
    ("connect", ":point_right:", "com"),
    (":point_right:", "on", "ig"),
    ("message", "on", "ig"),
    ("on ig", ":point_left:"),
    ("recommend", ":point_right:"),
    ("trade with", ":point_right:"),
    ("earn", "with", ":point_right:"),
    ("reach ", "on", "gmail", "com"),
    ("technopawns", "com"),
    ("jinxhacks", "com"),
    ("made more than", "$", "from"),
)

# --- Fixed values: combos on the normalised text ---
TEXT_SCAM_COMBOS = (
    ("appreciat", "recommend", ":point_up:"),
    ("free vbucks", "http"),
)

# --- Fixed values: combos on the (author, text) pair ---
PAIR_COMBOS = (
    (("contact",), ("username", "above")),
    (("com",), ("name", "above")),
    (("contact",), ("thank you",)),
    (("com",), ("you deserve", ":point_up:", "recommend")),
    (("via ig",), ("when i met ", ":arrow_up:", "thank you")),
)

# --- Fixed values: known copy-paste spam ---
KNOWN_SPAM_COMBOS = (("waffle house ", "found ", "new host"),)

# --- Fixed values: link spam; each combo also needs a video link ---
VIDEO_LINK = r"youtu\.?be(\.com)?/"

LINK_COMBOS = (
    ("re:finally it(’|'|)s here",),
    ("re:it(’|'|)s finally here",),
    ("re:let(’|'|)s be honest we all enjoyed this video by having this",),
    ("re:i think you(’|'|)re looking for this",),
    ("here finally",),
    ("here is what happened",),
    ("here ", "is ", "full short"),
    ("here", "the video that explains"),
    ("last fight",),
    ("re:here is the full (vid|clip)",),
    ("link to the clip", "re:it(’|'|)s time"),
    ("link to the clip", "re:that(’|'|)s going viral"),
    ("link to the clip", "thank me later"),
    ("link to the clip", "bots"),
    ("link to the clip", "part 2"),
    ("this is the clip", "looking for"),
    ("have been waiting so long for this",),
    ("here is", "vid", "you have been waiting for"),
    ("here is the recommended clip",),
    ("full recommended clip",),
    ("full video is up on my page",),
    ("this is the reason jesus died for",),
    ("this is my response to",),
    ("funny footage of", "raping"),
    ("re:^full video:",),
    ("full vid", ":arrow_forward:"),
    ("funny vid", ":arrow_forward:"),
    ("full video", "this is what my boss said"),
    ("check out the full",),
    ("click this if you like",),
    ("you can watch ", "it here"),
    ("since the video ", "here is the backup"),
    ("believe", "it is finally released"),
)

# --- Fixed values: styled digits, and the parts of a disguised phone prefix ---
STYLED_DIGITS = "߁੨૩౩౽႘①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒０-９𑄽𝟎-𝟿🄀-🄌"
STYLED_DIGIT_MINIMUM = 6
STYLED_PLUS = (
    "┼╂╋十┿✚✙➕±˖ᐩ⁺₊∓∔⊕⊞⟴⧺⧻⨁⨄⨢⨣⨤⨥⨦⨧⨨⨭⨮⨹⩱⩲⬲﹢＋᛭⁜☩☨☦♰♱⛨✚✛✜✝✞✟✠Ꚛꚛ"
    "🕀🕁🕂🕆🕇🕈🞡🞢🞣🞤🞥🞦🞧"
)
STYLED_ONE = "１𝟏𝟙𝟣𝟭𝟷⒈⓵❶➀➊🄂߁①⑴"

PHONE_PREFIX = f"[{STYLED_PLUS}] ? ?1|[+] ? ?[{STYLED_ONE}]|[{STYLED_PLUS}] ? ?[{STYLED_ONE}]"

# --- Fixed values: what the live profile changes ---
LIVE_AUTHOR_CHANGES = {("hack", "on", "tele"): ("hack", "on", "teleg")}
LIVE_TEXT_CHANGES = {
    ("appreciat", "recommend", ":point_up:"): ("appreciat", "recommend", ":point_up"),
}
LIVE_PAIR_CHANGES = {
    (("com",), ("you deserve", ":point_up:", "recommend")):
        (("com",), ("you deserve", ":point_up", "recommend")),
}
LIVE_EXTRA_PAIRS = ((("re:^@\\w+", "dmme"), (":point_up", ":gift:")),)
LIVE_EXTRA_LINKS = (("here", "the full vid", "that explains"),)


@dataclass(frozen=True)
class RuleBook:
    """All lists one cascade reads."""

    author_scam: tuple = AUTHOR_SCAM_PHRASES
    author_no_video: tuple = AUTHOR_NO_VIDEO_PHRASES
    author_ad: tuple = AUTHOR_AD_PHRASES
    text_scam: tuple = TEXT_SCAM_PHRASES
    text_filled: tuple = TEXT_FILLED_PHRASES
    author_combos: tuple = AUTHOR_COMBOS
    text_combos: tuple = TEXT_SCAM_COMBOS
    pair_combos: tuple = PAIR_COMBOS
    known_spam: tuple = KNOWN_SPAM_COMBOS
    link_combos: tuple = LINK_COMBOS
    video_link: str = VIDEO_LINK
    lookalikes: dict | None = field(default=None, hash=False)

    @classmethod
    def live(cls) -> "RuleBook":
        return cls(
            author_combos=tuple(LIVE_AUTHOR_CHANGES.get(c, c) for c in AUTHOR_COMBOS),
            text_combos=tuple(LIVE_TEXT_CHANGES.get(c, c) for c in TEXT_SCAM_COMBOS),
            pair_combos=tuple(LIVE_PAIR_CHANGES.get(c, c) for c in PAIR_COMBOS) + LIVE_EXTRA_PAIRS,
            link_combos=LINK_COMBOS + LIVE_EXTRA_LINKS,
        )

    @classmethod
    def from_lists(cls, lists: dict) -> "RuleBook":
        """From parsed JSON: any subset of the fields, lists for tuples."""

        def freeze(value):
            return tuple(freeze(v) for v in value) if isinstance(value, list) else value

        return cls(**{name: freeze(value) for name, value in lists.items()})
