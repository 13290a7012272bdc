"""Regexes that find a phrase even when its letters are replaced by look-alike glyphs.

Each letter has a class of glyphs, given as a fixed table. Pass another ``table`` to ``spelling``
to use different look-alikes; a character without a class stands for its own cases only.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The glyphs that pass for a letter, the letter included. Invisible and right-to-left
# ones are written as escapes.
GLYPHS = {
    " ": "\u202F\u2008\u2028\u2004\u2002\u2006\u2001\u205F\u2007\u1680\u2000\u2029\u2003\u00A0 \u2009\u2005\u200A",
    "*": "\u066D⁎*𐌟∗",
    ".": "꘎․.\u0701\U00010A50۰𝅭\u0660\u0702ꓸ",
    "4": "𝟺Ꮞ𝟜4𝟰ꮞ𑣏🯴𑢯𝟦𝟒",
    ":": "։᛬\u02F8\uA789︰:ः᠃ઃꓽː\u05C3：⁚\u0704∶\u0703᠉",
    "a": (
        "𝖺ǞÂ𝚨Ȁ𝚊ǟ𐊠Åȁ𝛼𝑨ᗅ𝜶ạȦậ𝙖𝘼ǠẦâᎪ𝔸𝐀ａ𝘢𝞐ÃaẶȃẪ𝓐𝒂ặǍ𝓪⍺ā𝗔ả𝗮ΑẮ𝞪𝒶ĂÄẩẠАầẳąắ𝔞𝙰ᴀăẬꓮẲ𝒜𝖆ᵃȂ@Ẵа𝛢𝝖𝖠ＡĀ𝘈ɑẨáⱭ"
        "ǻḁ𝐚𝝰å𝑎ȧǎ𝜜ẚÀǺ𝐴ẫḀấAꭺ𝕒äαãĄàẤÁ𝛂ǡ𝕬Ằằ𖽀ÅẢẵ𝔄"
    ),
    "b": "ＢꞴḂ𝕓𝖇Ь𝑏ʙ𝔟ВвьᏴꞵ𝐵𝒃ᏼꓐ𝘣𝔹𝘉ßḇ𝔅ḅ𝘽βḄ𝖻𐌁𝗯𝐛𝖡𝓫𝓑ｂꮟ𝛣ᖯ𝜝𝑩Β𝒷ḃƅ𝙗Ƅ𝙱𐊡ϐᗷ𝚋𝚩𝝗ᑲℬḆbB𝗕Ꮟ𝕭𝐁𝞑𐊂",
    "c": "Ċ𝔠ċḈ𝕔СҪ🝌𝘊č𝐶𝘤ᏟCc𝓒𝓬ⅽ𝒞𝕮ℂĈ𐌂ⲥｃ𝖈ᴄ𝑐ḉϹ𝖼𐔜ℭČ𐐕𝒄𝗰𐐽𑣩𑣲𝘾Ćć𝐜ꓚ𝚌𐊢Ⅽ𝐂ç𝗖𝙲ꮯ𝖢Ⲥ𝒸ϲＣсÇ𝑪ĉ𝙘",
    "d": "𝖽𝙙ꓓ𝕯𝑑ⅾ𝒹𝖉𝘿𝗱𝙳ḒḏꓒᏧ𝐃d𝘥𝘋𝐝Ḍ𝔡Ď𝒟𝒅𝔻Ḏꭰ𝚍ďⅮԀ𝕕ḓḑᑯᎠḊꮷᗪ𝐷𝖣Dᗞḋ𝓭ⅅ𝗗ᴅ𝔇𝑫ԁⅆḐḍ𝓓",
    "e": (
        "𖼻E𝝐𝒆𝖤𝈆ẹƷȄ𝖾ꬲÊ𝛦𝟹зḕḖ𝗲🯳êềΕ𝚎𝕰𝙚ꮛ𝟄𐊆é𝕖Є𝔼ËɛЕỄＥ𝖊𝑬𝓮ⳍ𑣆𝜀𝟑3Ɜ𑢪èĚｅȇĘẼ𝛜𝜖Ꭼ𝜺Ḙ𝓔ëḙĕҽęӠḔȨе𝔢ḗẻⴹ𝞮ℯᵉ𝗘ēℰĒế"
        "𝜠εÉє𑢮𝝚ȩꝫꞓẺ℮7ᴇ𝞔Ȇ𝞊ỀȜḚẽꞒe𝟛𝟥Ė𐐩ӡěḝ𝐞ЗÈⲉȅϵḛ⋴ꓰꭼꝪẸʒⅇ𝟯𝚬𝘌𑢦𝙀𝑒ⳌҼỆ𑣎ểḜȝỂ𝝴ễėɜԑ𝙴𝘦Ĕ⋿𝐄𑣊𝛆𝔈Ếệ𝐸"
    ),
    "f": "𝐅Sℱ𝖋𝘧fſ𝓯𝗙𑢢𝕗Ғ𝔽𝟊Ｆ𝙛𝈓𝘍𝗳ẝḟ𝐹𝚏ꬵꞘ𑣂Քｆ𝒻ꞙ𐊥𝒇𝔣ᖴ𝑓քꜰ𝐟𝟋Ḟ𝕱ғFϝ𝑭𐔥𝙁Ϝ𝔉𝖥ꓝ𝙵ɍ𐊇𝖿𝓕",
    "g": "ḠԍƓℊ𝕲Ğ𝐺𝚐ɠ𝐆Ց𝖌Ꮐ𝐠𝑔ᏻĜ𝖦𝘎𝗴ᶃᏳ𝘨ğ𝓖ᵍＧg𝒈𝙶𝔤𝔊ĝḡɢꮐᶢ𝙂ǧǦ𝗀ģ𝔾Ģ𝗚𝓰𝙜ց𝑮GĠǴｇꞬƍɡꓖ𝕘ġ𝒢ǵԌ",
    "h": "ʜ𝐻ḩ𝚮𝗵Ĥн𝙃Һ𝓗ｈẖ𝐇𝒉ȟ𝘩Հḣhꮋ𝕙𝛨ℍḥḢ𝑯ȞḨⲏꮒ𝕳𝘏𝙝ℌＨН𝖍𝐡𝙷𐋏η𝗛𝞖𝖧𝒽𝚑𝓱һ𝗁ĥℋ𝝜ᏂḫḦᕼհᎻⲎꓧℎḤΗḪ𝔥𝜢ḧH",
    "i": (
        "۱ī𝕀🯱𝔏𝚤𝚰ȈÎǀ\u07CA𝚕ℑ𝐋𑢲\u0661𝔦ịꞮⅼ𝝞Ⅼ𝓛ḸⲒꙇ𝑖\u05D5𝕚Ι𝐼Ⅰ𐌠！⏽ꭵǏ𝓘í𝓵I𖼖ͺ𝟙і𝙻î𝙸𝐥\u05DFǃĹ𑣃ĪｌìļÌ𝒍𝕴𝙇𝗶ˡ𝙄Ɩʟᣳ𝟣𝔩\U0001E8C7ιľᎥⅰ𝓲ḽ𝓁ı𝗜𝘓"
        "ɪＩÍ𝕃𝒾𝖨ḷḬḻ\U0001EE00\u05C0𝘐𝛪ḺỈįⅈȊ𝘪⍳𝕷Ï𝗅𝐢L\U0001EE80\u0345𐊊!𝗂ḯ𐔦𝜾𝕝\uFE8D𝖫𝑙|ⲓ𝖎ｉ1ḶiＬ∣𝟏ĬỊℓï𐐛Ļ𝐿𝙡𐌉𝖑\u02DBĨ𝐈ι𑢣ᛁᒪ𝝸𝑳ɩ𝗹ℐ𝟷𝈪𝗟ȋ𝞲𝞘\uFE8Eĭ𝜄ꓲḭ"
        "ⳐḼ𝘭ḮꙆІĺǐȉℒ𝚒𝒊ĩᏞĮİ𝟭𝑰𝜤ⵑӏỉ￨ꓡⵏ𝙞ḹl𖼨Ӏ𝛊Ľℹ\u0627"
    ),
    "k": "𝚱𝟆Ḳ𝞳ḵĸḳ𝛞𝔨ᛕḱK𝒦ǩ𝓚ⲕ𝐊𝒌𝚔𝐾𝓴𝗞𝝹𝙺𝘒𝜥Κ𝕜𝐤ⲔķḴｋ𝑘𝛫𝔎ꮶ𝜿𝘬Ꮶ𝓀𝗄𝛋kＫ𝞙K𝝟𝖐𝜅ꓗ𝑲𝝒𝖪𝞌𝙆𐔘КǨϰĶ𝕂к𝙠ᴋκḰ𝗸𝜘𝕶",
    "l": (
        "۱𝕀🯱𝔏𝚰ȈÎǀ\u07CA𝚕ℑ𝐋𑢲\u0661ⅼ𝝞𐑃Ⅼ𝓛ḸⲒ\u05D5Ι𝐼𐌠Ⅰ⏽Ǐ𝓘𝓵I𖼖𝟙і𝙻𝙸𝐥\u05DFⳑĹ𑣃Īｌļ𝒍Ì𝕴𝙇ˡ𝙄Ɩʟᣳ𝟣𝔩\U0001E8C7ιľ𑣒ⅰḽ𝓁ı𝗜𝘓ɪＩÍ𝕃𝖨ḷḻḬꮮ\U0001EE00\u05C0𝘐Ḻ𝛪Ỉ"
        "Ȋ𝕷Ï𝗅L\U0001EE80𐊊\u0345𐔦𝕝!\uFE8D𝖫𝑙|ⲓｉ1Ḷ∣𝟏iＬĬỊℓ𐐛Ļ𝐿𝙡𐌉𝖑Ĩ𝐈ᛁ𑢣ιᒪ𝑳ɩ𝗹ℐ𝟷𝈪𝗟𝞘\uFE8EꓲⳐḼ𝘭ḮІĺℒᏞ𝟭𝑰Įİ𝜤ӏ￨ꓡⵏḹl𖼨ӀĽ\u0627"
    ),
    "m": "𝒎ｍ𑜀𝚖µ𐊰𐌑𝕞𝑴Ṁ𝐌Μḿ𝓜𝚳ϺꮇḾ𝖬Ṃᛖᵐꓟ𝞛ṁ𝕸Ꮇ𝖒Ⲙℳ𝓶𝙼𝕄ᗰ𝑚𝘔𝓂𝗠ʍ𝗆𝜇ⅯＭꭑⲙ𝔐𝙢𝞵ⅿ𝘮μ𝛍ϻṃмm𝔪М𝝡𝙈𝜧𝐦ᴍ𝝁𝛭𝝻𝗺M𑣣𝑀",
    "n": "𝓃𝘯𝓝Ｎņ𐔓Ń𝞜ṄŅṆ𝐍𝑁Ñ𝚴𝘕ǹ𝗻𝐧𝗇ո𝓷ν𝙉𝙽𝝢ꓠ𝙣𝕹ռǸvṈɲŇñ𝔫𝒩𝑛𝖓ɴṅ𝕟Nｎṋⲛn𝖭Ν𝔑ṇńՈ𝚗𝜨𝑵𝛮Ṋ𝒏ℕ𝗡ňṉՌⲚ",
    "o": (
        "𝐎Ố𝛰Ṓồ𝞂Ọ\uFEEBଠỜõဝΣ6\U0001EE64𝑜Õộ𑣗𝐨𐊫Ǫ𑢷ổ໐\u07C0\uFBA7ȬՕṍ০๐σ🯰𝛐о\u06C1Ổ𑓐𝔒ớȫǑ\u0629ÒÓ𝚶౦ჿ\uFBA8Ô०ṓ೦𝘰𑣈\uFBA9Ȯ𝝈ȍȭŏ𝓞ơO𝜎ᴏ𝞸𝜪oം௦ṏ𝗈𝞞Ṏòꓳ𝝤ⵔ"
        "𝜊ỢỖŎ𝖮ȌōỚóỘợꬽ𝝄ṑ\U0001EE84ᴑỞỎ\u06D5۵𝒪օờ𝛔𑢨𑣕𑣠οỒǒ𝙊ỏ𝞼𝚘૦ȏ𝙾Ǭő\uFBAC𝟢ං\uFBA6ዐ𐊒𝟶𝑶ｏȱℴ0Ơ𝓸〇\uFEEAṐᲿỗŐ൦\u06BEＯ𐐬Ȏ၀𐓪\uFBAA𝔬\uFBABṌഠ𝟘𝖔𝒐੦Ỡǫⲟ𝗼𑢵"
        "ÖᎤ𝙤ố𝕠ಂ𝕆𝕺ỡОöȰ\U0001EE24Ō\u0647\uFBAD୦ⲞởôȪ𐓂\uFEEC𝝾𝟎𐔖𐐄\u05E1ȯ𝗢Ο𝑂𝟬ంọǭ\u0665\uFEE9𝘖"
    ),
    "p": "𝞀Ṗᴘ𝜚ᴩ𝜬𝐩𝗽Pｐꮲ𝝔Р𝕻Ρ𝖕ℙ𝞠ϱ𝛲𝟈𝝆𝗣ꓑᑭ𝗉Ꮲ𝓟ρ𝒑Ⲣ𝓅𝑝𝘗𝘱Ṕ𝙿𝛠𝙋𝚸𝒫𝕡𐊕𝖯𝙥𝞺𝜌ⲣ𝚙𝑷ṗ𝓹𝝦Ｐ⍴ṕ𝔭𝐏𝞎𝛒pр𝑃𝔓",
    "r": "гȓ𝙍ᖇ𝘳ℛℝŖ𝗿ṙṚṞṛ𝕣ｒᴦṜⲄ𝖱ȑ𝘙𐓜ʀ𝑟ꓣꮁꭱṟŗ𖼵ᎱřꭈⲅГ𝒓𝓇ℜ𝐫ŕ𝔯𝓡ꮢ𝚛𝑹ʳrŘＲꭇ𝚁Ŕ𝈖Ȓ𝖗𝑅ɾ𝐑Ṙ𝗥𝙧𐒴R𝓻ᣴ𝕽ȐṝᏒƦᎡ𝗋",
    "s": (
        "Ŝ𝖋𝘧ſf𝓯ꓢ𝕗Ｆș𝙛𝑆şＳ𝗳ẝ𝚏𝕊ṣꬵЅṥꮥ𝒻𝓢Ꮪ𝘚ŚṠŝ𐐠𝑓𝚂𝗌𝐒𝐟𝗦𝒮𝕤ṡ𖼺F𝔰ṧṦ𝑺s𑢡𝖿𝑠ṩ𝔖𝕾SᏕ𝙨𝓈Ṩտꜱḟƽ𝒔𐑈ｓ𝘀Ṥ𝖲ꞙȘ𝒇Ƽ𝔣ք𝖘ՏŞ𝐬ѕ𑣁"
        "ғ𝘴𝙎ꮪ𝓼Ṣś𐊖šŠ𝚜"
    ),
    "t": "𝚃ẗṭ𝛕ͲＴτŢ𝑻𑣜ṪṰ𝓽𝝉ｔ𝜏𐊱ꭲ𝚻Ṭ𝚝ţ𝞣𝘵𐌕ⲧΤ𝖙𝔗Ť𐊗𝗧𝑇𝝩𝞽Ț𝙏𝙩y𝔱ț🝨TṮ𝕥ṯ𝒕тᎢ𝑡Ⲧᴛ𝜯𝖳⊤𝗍𝘛ť𑢼𝓉𝐭𝐓ṱ𝕿Тͳ⟙ṫ𝓣t𖼊ꓔ𝕋𝞃𝒯ƫ𝛵𝘁",
    "u": (
        "𝕦𝛖𝝊ȗꭒṻụȖųṳṶǙʋṵ𝐮ᑌꭎ∪𝕌ǚ𐓶ūǓ𝑈𐓎Ù𝚞𝑢𝜐û𝗨Ůứư𝚄ȕỨü𝖴Ų𝖚Ʋ𝘜𝒖ṴƯửỮůŨ𝖀𝔲Üǖ𝙐Սυú𝙪ǕỤỰꞟսŪṺŭ𝘂Ṹ⋃𑢸𖽂𑣘ǘǔŰᴜ𝞾𝐔Ừ"
        "Υ𝑼ữ𝞄Ȕ𝔘ÛꞞሀừǗỬũǜuùỦＵ𝓾Ǜ𝘶ṹ𝗎Ṳꓴ𝓤ựṷ𝓊űŬｕủUÚ𝒰"
    ),
    "v": "Ṽ𝘝𝈍ⅴѵꮩ𝙑ᏙVṿ𝚟𝖛𝗏𝜈𑜆𝓋⋁νᐯ𝑽Ⅴ𝑉𝘃𝖁v𝒗𑢠𝓿ᴠＶ𝒱ⴸ𝔳𖼈𝖵\u0667ｖ۷𝑣𝐯𝗩𝝼𝕍ꛟ𝛎𝔙Ν𝓥Ṿ𐔝∨ṽ𝕧𝞶𝐕\u05D8𝚅𝝂𝙫Ѵꓦ𑣀𝘷",
    "w": "ŴѠẆ𝖜WẀ𝕎𝚆Ẃꓪ𑣯𑜏Ɯ𝔚𝔀ẉwԝ𝐖𝕨ẄԜ𝙒ẇѡẅ𝙬Աᴡ𝑾𝑤𝗪ẁꮤɯ𝗐ŵ𝖶𝖂ẃ𝒲𑜊Ꮤ𑣦ꮃ𝚠𝔴𝓌Ẉ𝘄Ꮃ𝓦ẘ𝘸𝑊ա𝐰𑜎𝒘𝘞",
    "x": "ẍΧ⤬𝙭ꭓ𝔁𝓍х᙭ꓫⲬ𐔧𑣬ⅹ𝝬×Ｘᚷ𝛸ⵝ𝟀⤫ｘ𝓧𝝌𝗑𝕩𝞆𝑋𝚇𐌢𝖝𝗫𝙓ẋᕁⲭ𝐗𐊴ẌХ𐌗ꭕ𝚾𝐱𝘅𝒳𝒙Ꭓ𐊐⨯𝚡𝑥᙮𝑿𝔵𝜲𝖃𝜒𝖷ᕽ𝕏X𝛘χ╳𝘟x𝞦Ẋ𝔛Ⅹ𝘹",
    "y": (
        "Ỷꭚ𝝪𑣜УȲ𝒚ýYᲧＹγŷỷỴỸｙ𝘠𝒴𝕪𝛾𝞬ꓬẙ𝞤𝚼𝖄𝔜𝔂ϒ𑢼Ẏȳ𐊲ỳⲩ𝝲ꮍzυ𝓎𝚢ℽŶ𝙔Ý𝖞𝑦ყ𝐘𝑌𝐲ỵ𝖸𖽃Ⲩү𝗒𝘺ỹΓ𝚈ΥŸ𑣄𑢤𝒀ƔyᎩ𝔶Ỳỿ𝜸ᶌu𝘆уɣҮ"
        "ꭹ𝙮ÿẏỾ𝛶𝕐𝓨𝛄𝗬𝜰Ꮍʏ"
    ),
    "࿕": "卐࿕",
    "࿖": "卍࿖",
}

# Stand-ins of more than one character.
SEQUENCES = {
    "c": ("C\u0326", "c\u0326"),
    "f": ("r\u0335", "Γ\u0335"),
    "g": ("g\u0314", "G'"),
    "h": ("n\u0329",),
    "m": ("rn",),
    "o": ("O'", "o'"),
}

# Fixed value: characters that may stand between letters, besides marks.
_JOINERS = r"[*_~|`\[\]()'\-.•,\p{Mn}]*"


def _escape(char: str) -> str:
    return rf"\x{{{ord(char):X}}}" if not (char.isascii() and char.isalnum()) else char


def _class(glyphs) -> str:
    return "[" + "".join(_escape(c) for c in sorted(glyphs)) + "]"


class LookalikeSpelling:
    """Phrase search over look-alike glyphs.

    Glyphs that belong to exactly the same letter classes are interchangeable, so text with
    characters beyond Latin-1 is first translated to one representative per such group. The
    phrase pattern then needs only a handful of glyphs per letter instead of hundreds.
    """

    def __init__(self, table: dict[str, str] | None = None):
        table = GLYPHS if table is None else table
        letters = set(GLYPHS) | set(table) | set("abcdefghijklmnopqrstuvwxyz0123456789")
        self.glyphs = {c: frozenset(table.get(c, "") or (c, c.lower(), c.upper())) for c in letters}

        member_of = defaultdict(set)
        for letter, glyphs in self.glyphs.items():
            for glyph in glyphs:
                member_of[glyph].add(letter)
        groups = defaultdict(list)
        for glyph, owners in member_of.items():
            groups[frozenset(owners), glyph.isalnum()].append(glyph)
        self.mapping = {}
        for group in groups.values():
            for glyph in group:
                if glyph > "\xff" and glyph != min(group):
                    self.mapping[glyph] = min(group)

    def canonical(self, text: Column) -> Column:
        """Interchangeable glyphs beyond Latin-1 become one; other text passes through."""
        ordered = dict(sorted(self.mapping.items()))
        swapped = F.translate(text, "".join(ordered), "".join(ordered.values()))
        return F.when(text.rlike(r"[^\x00-\xFF]"), swapped).otherwise(text)

    @lru_cache(maxsize=None)
    def letter(self, letter: str, canonical: bool = True) -> str:
        """Regex for one letter in any of its guises."""
        glyphs = self.glyphs[letter]
        single = _class({self.mapping.get(g, g) for g in glyphs} if canonical else glyphs)
        sequences = SEQUENCES.get(letter, ())
        if canonical:
            sequences = ["".join(self.mapping.get(c, c) for c in s) for s in sequences]
        if not sequences:
            return single
        return "(?:" + "|".join([*("".join(map(_escape, s)) for s in sequences), single]) + ")"

    @lru_cache(maxsize=64)
    def pattern(self, phrases: tuple, canonical: bool = True) -> str:
        """One pattern for any of ``phrases``; a phrase wrapped in ``\\b`` must stand alone."""
        spelled, firsts = [], set()
        for phrase in phrases:
            whole = phrase.startswith(r"\b")
            letters = phrase.removeprefix(r"\b").removesuffix(r"\b")
            body = _JOINERS.join(self.letter(c, canonical) for c in letters)
            spelled.append(rf"\b{_JOINERS}{body}{_JOINERS}\b" if whole else body)
            firsts |= {
                s[0] for s in (*self.glyphs[letters[0]], *SEQUENCES.get(letters[0], ()))
            }
        if canonical:
            firsts = {self.mapping.get(c, c) for c in firsts}
        lead = _class(firsts)
        if any(p.startswith(r"\b") for p in phrases):
            lead = f"[{lead}{_JOINERS.removesuffix('*')}]"
        # one class test rules out most positions before any phrase is tried
        return f"(?={lead})(?:{'|'.join(spelled)})"


@lru_cache(maxsize=4)
def _spelling(items) -> LookalikeSpelling:
    return LookalikeSpelling(None if items is None else dict(items))


def spelling(table: dict[str, str] | None = None) -> LookalikeSpelling:
    """Cached spelling for a look-alike table; None means the default table."""
    return _spelling(None if table is None else tuple(sorted(table.items())))
