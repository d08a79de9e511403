"""Language profiles: the patterns and word lists that text functions take."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """sentence_end: a class of characters after which a sentence is over.
    chapter_title: a line that opens a chapter.  impurity: a line of the site
    that a text was taken from.  name: a mention of a possible entity.
    quoted: direct speech."""

    sentence_end: str
    chapter_title: str
    impurity: str
    name: str
    quoted: str
    list_marker: str
    chars_per_token: float


#: Patterns of Chinese novels.
ZH_CHAPTER = "^[\\s　]*(第[一-鿿\\d]+[章回节部集]|[一二三四五六七八九十百千万]+[章回节部集]|楔子|序章|尾声|后记|番外|Chapter\\s+\\d+|CHAPTER\\s+\\d+)"
ZH_IMPURITY = (
    "起点中文网.*(?:阅读|网址|地址)",
    "最新章节.*(?:请收藏|网址)",
    "(?:手机|电脑)阅读.*(?:网址)",
    "下载.*(?:客户端|app).*阅读",
    "一秒记住|记住网址|请大家收藏",
    "www\\..*\\.(?:com|cn|net)",
    "http[s]?://",
    "(?:新书|本书).*(?:求收藏|求推荐|求票|求订阅)",
    "(?:求收藏|求推荐|求月票|求订阅|求打赏)",
    "作者.*(?:话|说|按|注)",
    "感谢.*(?:打赏|投票|支持)",
    "(?:打赏|投票|月票).*名单",
    "QQ群|微信群|公众号",
    "书友\\d+",
)
#: Those of the command-line cleaner.
ZH_CLI_IMPURITY = (
    "起点中文网.*(?:阅读|网址|地址)",
    "最新章节.*(?:请收藏|网址)",
    "(?:手机|电脑)阅读.*(?:网址)",
    "无广告.*阅读",
    "下载.*(?:客户端|app).*阅读",
    "一秒记住|记住网址|请大家收藏",
    "www\\..*\\.(?:com|cn|net)",
    "http[s]?://",
    "(?:新书|本书).*(?:求收藏|求推荐|求票|求订阅)",
    "(?:求收藏|求推荐|求月票|求订阅|求打赏)[.。！!]",
    "支持.*正版.*阅读",
    "投.*推荐票|月票.*投",
    "^PS[：:]|^P\\.S[：:]",
    "作者.*(?:话|说|按|注)",
    "（.*(?:未完待续|本章完|新书|加更|明天|更新).*）",
    "(?:未完待续|本章完|新书推荐)",
    "感谢.*(?:打赏|投票|支持)",
    "(?:打赏|投票|月票).*名单",
    "书友\\d+",
    "QQ群|微信群|公众号",
    "微信搜索",
    "防盗.*章节|章节.*防盗",
)
ZH_PUNCTUATION = "[\\s，。！？、；：（）()【】《》〈〉「」『』\"'.,!?;:\\-—…·]+"
ZH_TITLE_PREFIX = "^第[零一二两三四五六七八九十百千\\d]+[章回集节]\\s*"
ZH_DIGITS = "零一二三四五六七八九"
ZH_FALLBACK_NAMES = ("什么", "如何", "可以", "没有", "我们", "他们", "大家", "一个", "这个", "那个", "自己", "起来", "时候", "就是")
CONNECTIVES = ("和", "与", "、", "，", " ", "以及", "跟", "的关系", "在", "的")

ZH = Profile("。！？\n", ZH_CHAPTER, "(?i)" + "|".join(ZH_IMPURITY), "[一-鿿]{2,4}", "[「][^」]*[」]|[『][^』]*[』]|\"[^\"]*\"", "(?:打赏|投票|月票).*名单", 1.3)
LATIN = Profile(".!?\n", "^[A-ZÀ-Þ][^.!?|]{1,60}[.]?$", "(?i)www\\.[^ ]+\\.(?:com|net|org)|https?://|copyright|license|all rights|subscribe|password=|@mail[0-9]", "[A-ZÀ-Þ][a-zà-ÿ]+", "\"[^\"]*\"", "(?i)thanks to|members:|^tags", 4.0)
ZH_CLI = Profile(ZH.sentence_end, ZH_CHAPTER, "(?i)" + "|".join(ZH_CLI_IMPURITY), ZH.name, ZH.quoted, ZH.list_marker, ZH.chars_per_token)
