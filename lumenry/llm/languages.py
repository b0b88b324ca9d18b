"""Language of short texts by votes of stopwords."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Frequent function words by language (articles, pronouns, prepositions, conjunctions, auxiliaries).
STOPWORDS = {
    "en": "the a an of in and by at with as to that from is are was were for no one on it this these those watch so but under over while who where when "
    "what which how not i you he she we they me him them my your his her our their its be been being had has have do does did if or there every before "
    "after near across only into out up down off through between against about because until than then too very just can could will would should may might "
    "must all any each some such own same again once here why both few more most other am us",
    "af": "die van het en is in nie 'n wat vir met op hy sy ek jy ons hulle word sal kan maar ook deur baie waar toe nog oor uit om aan",
    "ca": "el la els les de del dels un una i que en amb per al als no és es són va ha com però més quan també aquest aquesta seva seu sense sobre entre",
    "cs": "a je v na se že z s do to pro za by jako ale když jsem jsou byl byla bylo není už jen tak jeho její která který které kde pod nad od ve ze si",
    "cy": "y yr yn a o i ar am mae ei eu oedd wedi gan gyda hyn fod bod ond neu dros dan wrth hwn nid pan fel",
    "da": "og i at det er en til på som de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du ud hende være når kan sin sine denne under mens uden ingen intet alt hver ved mellem efter før altid aldrig",
    "de": "der die das den dem des ein eine einer eines einen einem und oder aber ist sind war waren wird werden hat haben nicht kein keine mit ohne auf an am im ins in zu zum zur "
    "bei von vom nach vor aus über unter um durch für gegen wie wenn weil dass als auch noch nur schon sehr so er sie es ich wir ihr sich sein seine ihre mein während zwischen dieser diese dieses hinter niemand nichts alles jeder immer wieder dann wo wer was doch damit ohne neben",
    "eo": "la de kaj en al estas ne kiu por kun ke sed oni mi vi li ŝi ni ili ĝi tiu ĉi pri sur sub estis kiel",
    "es": "el la los las un una unos unas de del y o que en con por para al se su sus lo le es son está están fue era no como cómo cuando mientras pero más muy sin sobre "
    "entre bajo desde hasta hay ya también este esta esto ese esa yo mi tu nos qué quien donde porque nadie nada todo cada junto bajo cerca sino aunque aún según qué cuál tras ante",
    "et": "ja on ei see ta et ma oma kui oli mis aga nii ka ning kes või siis veel me nad selle seda tema ainult üle all",
    "eu": "eta da ez bat du dira zen baina ere hau bere egin dute izan zuen gure beste honek hori gainean azpian",
    "fi": "ja on ei se hän että oli olla mutta kun niin kuin tämä hänen ovat myös jos vain sen joka mitä minä sinä he me jo vielä kanssa alla yli kukaan kaikki joka vieressä välissä jälkeen ennen aina",
    "fr": "le la les un une des du de et ou que qui en dans sur sous avec pour par au aux ne pas plus est sont était a ont se ce cette ces son sa ses leur leurs il elle ils elles "
    "on nous vous je mais comme quand si sans entre vers chez très tout tous où même aussi quel quelle quels rien personne près devant derrière pendant après avant pourquoi aucun chaque toujours jamais puis donc l qu c",
    "ga": "agus an na is ar le do ag sa tá bhí ní go i de sé sí ach nó seo sin mar faoi chun gan bheith",
    "gl": "o a os as un unha de do da dos das e que en con por para ao se non é son como cando pero máis moi sen sobre entre xa tamén este esta eu",
    "hr": "i je u na se da su za s od nije kao ali sam si bi što koji koja koje ili iz po do ne kad kada samo još već dok pod nad njegov njezin uz bez",
    "hu": "a az és hogy nem is egy van volt de ez csak még már meg mint ha ki mi el fel alatt fölött között után aki ami vagy nagyon mert neki",
    "id": "yang dan di dari ke untuk dengan pada ini itu adalah tidak dia mereka kami kita saya akan telah sudah oleh juga atau karena seperti saat ketika sambil para sebuah seorang bawah atas dalam tak tiada semua setiap antara setelah sebelum dekat siapa",
    "is": "og að er á í sem það ekki hann hún við til um með fyrir en af var þetta þeir þær eru hafa verið ég þú undir yfir",
    "it": "il lo la i gli le un uno una di del della dello dei degli delle e o che in con per da dal dalla su sul sulla al alla nel nella non è sono era ha hanno si come quando mentre ma più "
    "molto senza sopra sotto tra fra anche questo questa quello suo sua perché chi cui io tu lui lei noi nessuno niente tutto ogni vicino lungo dopo prima mentre ancora quale nell dell all sull",
    "la": "et in est non ad cum ut sed per quod qui quae sunt ex ab de nec enim atque esse hic haec hoc ille eius sub inter",
    "lt": "ir yra į su kad ne iš tai kaip bet jis ji už nuo apie buvo tik dar jau po per prie kurie kai ant be jos jo",
    "lv": "un ir ar no uz ka par bet kas tas tā nav viņš viņa pie pēc tikai vēl jau bija kā to zem pār bez",
    "mt": "u l il ta li f fi ma minn huwa hija għal ma' dan din kif iżda jew kien kienet fuq taħt bejn",
    "nl": "de het een van en in op aan met voor bij naar uit over onder door om tot is zijn was waren niet geen dat die dit deze te er als maar ook nog wel al zo ik je hij zij ze we "
    "wij hun haar terwijl wanneer waar wat wie toen zonder tussen tegen wordt worden heeft hebben niemand niets alles elke naast langs onder toen want dus hier daar",
    "no": "og i det er en et til på som de med han av for ikke der var seg men har om vi min hun nå over da fra ut være når kan sin sine denne under mens uten jeg du ble blir ingen ingenting alt hver ved mellom etter før alltid aldri",
    "pl": "i w na z do się nie to że jest jak o a po od przez przy za dla ale czy tak są był była było już tylko jego jej ich ten ta który która które gdy kiedy pod nad przed ze nikt nic wszystko każdy obok między potem zawsze nigdy",
    "pt": "o a os as um uma de do da dos das e ou que em no na nos nas com por para pelo pela ao à se seu sua é são está foi era não como quando enquanto mas mais muito sem sobre "
    "entre até já também este esta isso ele ela eles elas eu nós porque onde ninguém nada tudo cada junto perto depois antes enquanto ainda qual após",
    "ro": "și în a de la cu pe nu că o un din ce este sunt mai se care pentru dar ca ei lui ea el au fost fără sub între când sau prin după până",
    "sk": "a je v na sa že z s do to pre za by ako ale keď som sú bol bola bolo nie už len tak jeho jej ktorá ktorý ktoré kde pod nad od vo zo si",
    "sl": "in je v na se da so za z s od ni kot ali pa bi ki ko ne iz po do tudi samo še že med pod nad brez njegov njen",
    "sq": "dhe në e të i një është nga për me që nuk si por më ai ajo ata këtë kjo ka janë pa mbi nën kur",
    "sv": "och i att det är en ett till på som de med han av för inte där var sig men har om vi min hon nu över då från ut vara när kan sin sina denna under medan utan jag du ska blev ingen inget allt varje bredvid mellan efter innan alltid aldrig",
    "sw": "na ya wa kwa ni katika za la si hii huu yake wake kama lakini au bado hiyo alikuwa kuwa sana pia ambayo chini juu",
    "tl": "ang ng sa mga na at ay si ni kay hindi ito siya sila ako ikaw kami tayo para kung pero may mula habang nang lang din rin kapag",
    "tr": "ve bir bu da de için ile çok ama gibi daha ne o en var yok mi mı olarak olan sonra kadar her ben sen biz siz onlar onun değil ki iken altında üstünde hiç her yanında sonra önce şey kimse",
    "vi": "và là của có cho không được một trong với các những này đó khi người đã đang sẽ từ trên dưới ra vào như nhưng cũng rất",
}
# Words of other languages' lists that English has too, besides its stopwords; alone they tell nothing.
HOMOGRAPHS = frozenset(
    "ad al amo au bad bat bath bin bod but cant care chi come con dan dare den dent dies din dove due dun ear era ex fan far fin fur gar go hat hen hi "
    "ho hoc hon ill jag juice just kind la lang led li lie lit lo ma mail man mar mare mark mas may men mid mine mint most na nag net nod non nor nun "
    "nut o os own pa pan par past pet pie pod pour pro ride rot sage sale same sang se sea si side sin sine sit so sol sole some son sons star sub sun "
    "sur ta tag tale tan tape te tea ten ti tie time toe tot tout van ver via wet wit won yak yes plus per e s l u y z d n f t m c".split()
)


def _forms(word: str) -> set[str]:
    """A word as written, without its accents, and without the letters that ``tokenize`` deletes."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return {word, folded, re.sub("[^a-z']", "", word)} - {""}


_NAMES = ("en", *(name for name in STOPWORDS if name != "en"))
_SETS = {name: frozenset(f for w in STOPWORDS[name].split() for f in _forms(w)) for name in _NAMES}
#: For each word the languages that have it, as bits in the order of ``_NAMES``, and a last bit if English has it too.
_BITS: dict[str, int] = {}
for _place, _name in enumerate(_NAMES):
    for _w in _SETS[_name]:
        _BITS[_w] = _BITS.get(_w, 0) | 1 << _place
_SHARED = 1 << len(_NAMES)
for _w in _BITS.keys() & (HOMOGRAPHS | _SETS["en"]):
    _BITS[_w] |= _SHARED
_OTHERS = _SHARED - 2
_WORD = re.compile(r"[^\W\d_]+")


def foreign_words(words: list[str]) -> bool:
    """Whether the stopwords of another language outvote English.

    A word that both have votes for both; two votes must be the other
    language's own, or one of three.
    """
    masks = [m for w in words if (m := _BITS.get(w))]
    english = sum(m & 1 for m in masks)
    own = [m for m in masks if not m & _SHARED]
    if not own:
        return False
    for i in range(1, len(_NAMES)):
        if n := sum(m >> i & 1 for m in own):
            total = sum(m >> i & 1 for m in masks)
            if total > english and (n >= 2 or total >= 3):
                return True
    return False


def _masks(vocabulary: list[str], codes: np.ndarray) -> np.ndarray:
    return np.fromiter((_BITS.get(w, 0) for w in vocabulary), np.int64, len(vocabulary))[codes]


def foreign_rows(vocabulary: list[str], codes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """``foreign_words`` of ``n`` texts at once, given as places in a vocabulary and the text of each."""
    masks = _masks(vocabulary, codes)
    english = np.bincount(row, weights=masks & 1, minlength=n)
    others = np.bincount(row, weights=masks & _OTHERS > 0, minlength=n)
    own = np.bincount(row, weights=(masks & _OTHERS > 0) & (masks & _SHARED == 0), minlength=n)
    doubtful = (own > 0) & (others > english)
    out = np.zeros(n, dtype=bool)
    if doubtful.any():
        some = doubtful[row] & (masks > 0)
        masks, row = masks[some], row[some]
        for i in range(1, len(_NAMES)):
            vote = masks >> i & 1
            total, alone = np.bincount(row, weights=vote, minlength=n), np.bincount(row, weights=vote * (masks & _SHARED == 0), minlength=n)
            out |= (total > english) & ((alone >= 2) | (alone >= 1) & (total >= 3))
    return out & doubtful


def english_rows(vocabulary: list[str], codes: np.ndarray, row: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Texts of ``count`` words of which English stopwords are a fifth and outvote by far the words that only other languages have."""
    masks = _masks(vocabulary, codes)
    english = np.bincount(row, weights=masks & 1, minlength=len(count))
    own = np.bincount(row, weights=(masks & _OTHERS > 0) & (masks & _SHARED == 0), minlength=len(count))
    return (english * 5 >= count) & (english >= 4 * own) & (count > 0)


def is_foreign(text: str) -> bool:
    """Whether a text is mostly in letters other than Latin ones, or in another language by its stopwords."""
    words = _WORD.findall(text.lower())
    letters = sum(map(len, words))
    if not letters:
        return False
    if not text.isascii() and sum(c > "ɏ" and not "ḁ" <= c <= "ỹ" for w in words for c in w) * 2 > letters:
        return True
    return foreign_words(words)
