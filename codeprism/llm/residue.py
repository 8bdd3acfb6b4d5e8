"""Texts in which the content is missing: unfilled templates, filler, error pages and script notices.

Normalised lines are counted over all documents, by host and altogether; what recurs beside other
text is boilerplate (menus, footers). It is subtracted from each text, as are code and quotations. A
text is excluded when a slot was left unfilled in what runs on as text, or when all that is left is
evidence: an error or access page, a request for scripts, cookies or a browser, filler, or a stub.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised

FENCE = re.compile(r"(?m)^[ \t]*(`{3,}|~{3,})[^\n]*\n[\s\S]*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)")
INLINE = re.compile(r"(`+)(?:(?!\1)[^\n])+\1")
QUOTED = re.compile(r"\"[^\"\n]{2,200}\"|“[^”\n]{2,200}”|„[^“”\n]{2,200}[“”]|「[^」\n]{2,200}」|‘[^’\n]{2,200}’")
COMMENT = re.compile(r"<!--[\s\S]*?-->")
BLANK = re.compile(r"[\s​-‏⁠﻿­]+")
SEEN = re.compile(r"[^\s​-‏⁠﻿­]")
NAV = re.compile(r"^(?:[≡☰]\s*\w{0,12}|(?:skip to|back to) \w+(?: \w+)?)$", re.I)
DIGITS = re.compile("[0-9]+")
BETWEEN = re.compile(r"[|·•›»]")

# fixed values: the ways in which templates write a slot
SLOT = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\$\{[^{}\n]{1,60}\}|\#\{[^{}\n]{1,60}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|(?-i:%[A-Z][A-Z_]{1,40}%)|%\([a-z_]+\)s|\b__[A-Za-z]+(?:_[A-Za-z]+)*__\b|(?<![\w$])\$[a-z_]{2,30}\$(?![\w$])"
    r"|@@\w{2,40}@@|\[\[[\w .-]{1,40}\]\]|\[(?:(?-i:[A-Z]{2,}(?:[ _][A-Z]{2,})+)|(?:insert|your|enter|add)\b[^\]\n]{1,40})\](?!\()|<(?:insert|your|enter|add)[ _-][^<>\n]{1,40}>"
    r"|(?<![\w{$#`])\{[a-z]+(?:[._ ][a-z]+){0,3}\}(?!\})|«[a-z]+(?:[._ ][a-z]+)?»"
    r"|\b(?:dear|hi|hello|hallo|liebe[r]?|bonjour|cher|chère|hola|estimad[oa]|ciao|gentile|beste|prezad[oa])[ ,]+(?:<[^<>\n]{2,40}>|\[[^\[\]\n]{2,40}\](?!\()|(?-i:(?:FIRST|LAST|FULL|USER|CUSTOMER)[ _]?NAME)\b)|<(?:first|last|full|user|customer|company|product)[ _-](?:name|id|email)>|(?-i:(?<=[a-z,] )\[[A-Z]{4,}\](?!\())",
    re.I,
)

SLOT_MARKS = re.compile(r"[{\[<%$«@]|__|NAME")

# fixed values: what error pages, notices and stubs say, in the languages of the documents
ERROR = re.compile(
    r"^(?:error|http|status)?:?\s*[45]\d\d\b.{0,50}$|^\W*\{\s*\"?(?:error|errors|fault)\"?\s*:|^(?:fatal|error|panic|exception):|^traceback \(most recent|^\s*at \S+ \(|^(?:[\w.]+)?(?:Error|Exception):"
    r"|(?:page|file|document|site|resource|url)\b.{0,60}(?:not found|does not exist|could ?n[o']t be found|was moved|could not load)|^not found|could not load|nicht gefunden|introuvable|no (?:se ha|se pudo|fue) encontrad|no encontrad[ao]|non (?:è stata )?trovat|niet gevonden|nie (?:została )?znalezion|não (?:foi )?encontrad|не найден|見つかりません|未找到|找不到|不存在|찾을 수 없"
    r"|access (?:is )?denied|forbidden|no permission|not (?:allowed|authori[sz]ed) to|unauthori[sz]ed|zugriff verweigert|accès refusé|acceso denegado|acesso negado|accesso negato|toegang geweigerd|odmowa dostępu|доступ (?:запрещ|закрыт)|アクセス.{0,12}(?:拒否|権限)|拒绝访问|没有权限|액세스.{0,8}거부|권한이 없"
    r"|internal server error|bad gateway|service (?:is )?(?:temporarily )?unavailable|gateway time-?out|something went wrong|went wrong on our|please try again|timed out|connection (?:refused|reset)|too many requests|has been (?:rate )?limited|(?:sign|log) in again|could not (?:be reached|reach|connect)|(?:un|not )(?:reachable|available)\b"
    r"|session (?:has |a |est )?expir|sitzung ist abgelaufen|sesión ha (?:caducado|expirado)|sessione è scaduta|sessão expir|sessie is verlopen|sesja wygasła|сесси\w+ (?:истек|заверш)|セッション.{0,8}(?:切れ|期限)|会话.{0,4}(?:过期|超时)|세션.{0,8}만료"
    r"|veuillez vous reconnecter|melden sie sich (?:bitte )?erneut an|(?:vuelva|volver) a iniciar sesión|accedi di nuovo|faça login novamente|log opnieuw in|zaloguj się ponownie|войдите (?:снова|ещё раз)|再度ログイン|重新登录|다시 로그인"
    r"|verify (?:that )?you are (?:a )?human|checking your browser|(?:this takes|takes) a few seconds|go back to the (?:start|home)|zur startseite|prüfen sie die adresse|retour(?:nez)? à l'accueil|revenez à l'accueil|アドレスを確認|entschuldigung.*fehler|ein fehler ist aufgetreten|une erreur est survenue|ha ocurrido un error|si è verificato un errore|ocorreu um erro|произошла ошибка|エラーが発生|发生错误|出错了|오류가 발생",
    re.I | re.M,
)
SCRIPTS = re.compile(
    r"(?:javascript|java script|\bscripts?\b|cookies?|скрипт|куки|脚本|スクリプト|クッキー|스크립트|쿠키|자바스크립트).{0,90}(?:enable|require|need|turn|allow|switch|disabled|activ|aktivier|besoin|nécessaire|requier|necesit|habilit|attiv|abilit|ative|precisa|inschakel|vereist|nodig|włącz|wymaga|включ|требу|有効|必要|启用|开启|需要|활성|필요|켜)"
    r"|(?:enable|requires?|needs?|turn on|allow|switch on|activate|aktivieren|activez?|active|activa|habilite|besoin d[eu']|nécessite|requiere|necesita|richiede|exige|precisa de|vereist|benötigt|wymaga|требует|attiva(?:re)?|abilita|ative|inschakelen|schakel|włącz|включите|启用|开启).{0,60}(?:javascript|\bscripts?\b|cookies?|скрипт|脚本)"
    r"|browser.{0,40}(?:not supported|unsupported|too old|out of date|outdated|veraltet|nicht unterstützt)|(?:update|upgrade) (?:it|your browser) or use another|navigateur.{0,40}(?:pas pris en charge|obsolète)|navegador.{0,40}(?:no (?:es )?compatible|não (?:é )?(?:compatível|suportado))|switch them on and reload|activez-le|actívelo|もう一度お試しください",
    re.I,
)
STUB = re.compile(
    r"coming soon|under construction|intentionally (?:left )?blank|^untitled\b|click (?:here )?to (?:add|edit)|start (?:writing|typing) here|^new page$|^loading\b|if nothing appears|(?:goes|comes) here\b|replace this (?:text|line|paragraph)|^(?:\W*)(?:write|describe|add|enter|insert|fill in|list) (?:a|an|the|your|it)?\b.{0,50}\b(?:here|summary|introduction|description|limits|example)\W*$"
    r"|^\W*(?:todo|tbd|fixme)\b:?\s*(?:write|add|list|describe|fill|document|explain)?\b.{0,60}$|\(?hier (?:eintragen|einfügen|ausfüllen)\)?|^\W*(?:name|title|text|date) here\W*$|^job title$|delete (?:one|two|three|as appropriate)|^\W*\[[ x]?\]\W*$|^(?:\d+\.|[-*+])$"
    r"|^(?:(?:undefined|null|nan|none|n/a|invalid date)\b|\[object object\])(?:[\s,:;]*(?:undefined|null|nan|none|by|on|refs?|of|\[object object\]|invalid date|\d+)(?!\w))*\W*$|folgt in kürze|in bearbeitung|próximamente|à venir\b|bientôt disponible|prossimamente|em breve\b|binnenkort|wkrótce|скоро (?:здесь|будет)|近日公開|準備中|即将(?:推出|上线)|建设中|준비 중"
    r"|^[\w ]{2,30}:\s*(?:\((?:[^()\n]{2,40})\)|_{3,}|\.{3,}|…|-{2,}|)\s*$",
    re.I | re.M,
)
# fixed values: endings of the words of pseudo-Latin
LATIN = re.compile(r"(?:um|us|ur|am|em|im|at|et|it|is|as|os|es|or|unt|ant|ent|ec|ro|ris|ra|da|ta|tur|con|in|set|bus)\Z")
#: A line that goes with an error page: who answered, or under which number.
SIGNATURE = re.compile(r"^(?:[\w-]+ ){0,3}(?:at|from|by|on|via|id|ref|reference|ray|request|server|host|proxy|nginx|apache)\b[ :#]*[\w.:/#-]+\W*$", re.I)
#: A literal of each alternative above (~ is a blank), and the alternatives that have none.
STEMS = (
    "error fault fatal panic exception traceback ~at~ found exist could~not couldn't moved not~load nicht introuvable encontrad trovat niet nie~ encontrad не~ 見つか 未找到 找不到 不存在 찾을 denied forbidden permission allowed authori"
    " verweigert refusé denegado negado negato geweigerd odmowa доступ アクセス 拒绝 权限 거부 권한 gateway unavailable unreachable available wrong try~again timed~out connection too~many limited again reach expir sitzung sesión sessione sessão sessie sesja сесси セッション"
    " 会话 세션 reconnecter erneut iniciar accedi novamente opnieuw ponownie войдите ログイン 登录 로그인 human browser seconds back~to startseite adresse accueil アドレス fehler erreur errore erro błąd произошла エラー 错误 出错 오류 javascript java~script script cookie скрипт куки 脚本"
    " スクリプト クッキー 스크립트 쿠키 자바스크립트 navigateur navegador switch activez actívelo もう一度 coming~soon construction blank untitled click start~ new~page loading appears here replace todo tbd fixme eintragen einfügen ausfüllen summary introduction description limits example"
    " job~title appropriate undefined null nan none n/a object invalid delete update~it folgt bearbeitung próximamente venir bientôt prossimamente breve binnenkort wkrótce скоро 近日 準備 即将 建设 준비"
)
BARE = re.compile(r"^\W*[45]\d\d\b|^\W*\[[ x]?\]\W*$|^(?:\d+\.|[-*+])$|:\s*(?:\([^()\n]{2,40}\)|_{3,}|\.{3,}|…|-{2,}|)_*\s*$", re.M)
CODED = re.compile(r"[`(){}=_\d]")
LOREM = re.compile(r"\b(?:lorem|ipsum|dolor|amet|consectetur|adipis\w+)\b", re.I)
COMMON = re.compile(r"\b(?:the|and|is|are|of|to|that|with|der|die|und|ist|le|les|des|est|que|los|las|por|il|che|di|het|een|niet|nie|jest|się|não|uma|para)\b", re.I)
END = re.compile(r"(?<![.!?。！？])[.!?。！？]+(?=\s|$|[^\x00-\x7f])")
KNOWN_LINES = 200_000  # recurrent lines, 8 bytes each, up to which all workers get those of all hosts
RUN = 600  # words that are looked at together for repeats: in a longer text even real words repeat


def normalised(line: str) -> str:
    return DIGITS.sub("0", line.strip(" \t\n\r\f\v")).lower()


def line_hash(line: str) -> int:
    """What Spark's xxhash64 gives for a string."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


class Recurrent:
    """Membership of normalised lines in sets of their hashes."""

    def __init__(self, *sets):
        self.sets = [s for s in sets if s]

    def __contains__(self, line: str) -> bool:
        h = line_hash(line)
        return any(h in s for s in self.sets)


def navigation(line: str) -> bool:
    """A menu sign, a jump, or three and more short entries side by side."""
    parts = BETWEEN.split(line)
    return bool(NAV.match(line)) or len(parts) > 2 and all(p and len(p.strip()) <= 18 for p in parts)


def sentences(line: str) -> Iterator[str]:
    at = 0
    for m in END.finditer(line):
        yield line[at : m.end()]
        at = m.end()
    yield line[at:]


def repeated(words: list[str]) -> bool:
    kinds = len(set(words))
    return kinds <= max(4, len(words) // 12) and kinds * 2 <= len(words) and len(words) / kinds >= 3


def filler(text: str) -> bool:
    """Pseudo-Latin, or a few words said over and over, in each run of a longer text."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    if len(words) >= 5:
        runs = max(1, len(words) // RUN)
        if all(repeated(words[len(words) * i // runs : len(words) * (i + 1) // runs]) for i in range(runs)):
            return True
    if len(words) >= 6 and LOREM.search(text) and not COMMON.search(text):
        return True
    if len(words) >= 8 and text.isascii() and not CODED.search(text) and not COMMON.search(text) and sum(map(bool, map(LATIN.search, words))) >= 0.7 * len(words):
        return True
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return len(lines) >= 4 and len(set(lines)) == 1


@lru_cache(maxsize=1)
def _stems():
    """Finds literals of which every alternative of ERROR, SCRIPTS and STUB has one, in lower case."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in STEMS.split():
        a.add_word(w.replace("~", " "), True)
    a.make_automaton()
    return a


def sign(sentence: str) -> str | None:
    """error, script or stub where a sentence is evidence of it."""
    if next(_stems().iter(sentence.lower()), None) is None and not BARE.search(sentence):
        return None
    return "error" if ERROR.search(sentence) else "script" if SCRIPTS.search(sentence) else "stub" if STUB.search(sentence.strip().strip("_")) else None


def weighed(lines: list[str]) -> str | None:
    """error, script, stub where nearly all that the lines say, but for quotations, is evidence of it."""
    size = sum(map(len, lines)) + len(lines) - 1
    good = bad = 0
    kind = None
    for x in lines:
        if re.match(r"\W*\{|(?:fatal|error)|\s*at ", x, re.I) and ERROR.search(x):
            bad += len(x)
            kind = kind or "error"
            continue
        if kind == "error" and len(x) < 80 and SIGNATURE.match(x):
            bad += len(x)
            continue
        strong = None
        own = QUOTED.sub(" ", x)
        for s in sentences(own if SEEN.search(own) else x):
            if not s.strip():
                continue
            k = sign(s)
            strong = strong or k
            # a short sentence beside evidence belongs to the same notice
            if k or strong and len(s) < 50 or filler(s):
                bad += len(s)
                kind = kind or k
            else:
                good += len(s)
                if good > 0.2 * size:
                    return None  # the rest cannot make up for it
    return kind if kind and bad >= 0.8 * (good + bad) else None


def evidence(line: str) -> bool:
    """A short line is evidence by any sign in it; a line of 400 characters or more, by what nearly all of it says."""
    if len(line) >= 400:
        return weighed([line]) is not None
    return sign(line) is not None


def missing(text: str | None, boilerplate: frozenset | Recurrent = frozenset()) -> str | None:
    """slot, filler, error, script or stub where the content of ``text`` is missing, else None."""
    if text is None or not SEEN.search(text):
        return None
    running = INLINE.sub(" ", FENCE.sub("\n", text))
    had_code = "`" in text
    said = QUOTED.sub(" ", running)
    if SLOT_MARKS.search(said) and SLOT.search(said):
        return "slot"
    hint = COMMENT.search(running)
    lines = [x for x in (y.strip() for y in COMMENT.sub("", running).split("\n")) if SEEN.search(x)]
    kept = [x for x in lines if not (navigation(x) or normalised(x) in boilerplate) or evidence(x)]
    body = [x for x in kept if not re.match(r"#{1,6}\s", x)]
    if not body:
        return None if had_code or not (hint or len(kept) < len(lines)) else "stub"
    whole = "\n".join(body)
    if had_code and len(text) - len(running) > len(whole):
        return None
    if filler(whole) or LOREM.search(whole) and not COMMON.search(whole):
        return "filler"
    return weighed(body)


def recurrent(docs: DataFrame, key: str, text: str, host: str, host_share: float, share: float) -> DataFrame:
    """``_h, line``: hashes of the normalised lines that recur in a host, or everywhere (a null host).

    A line is 8 bytes in the shuffle, whatever its length. It is counted once a document. At most 1 / host_share times the mean number of lines of a
    document can recur in a host, which bounds the list of each host.
    """
    split = F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), "[0-9]+", "0")))))
    lines = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("_h"), split.alias("line")).where((F.length("line") > 1))
    lines = lines.select("_h", F.xxhash64("line").alias("line"))
    counts = lines.groupBy("_h", "line").agg(F.count(F.lit(1)).alias("n"))
    sizes = docs.where(F.col(text).isNotNull()).groupBy(F.col(host).alias("_h")).agg(F.count(F.lit(1)).alias("docs"))
    own = counts.where("n >= 3").join(sizes, "_h").where(F.col("n") >= host_share * F.col("docs")).select("_h", "line")
    total = sizes.agg(F.sum("docs").alias("all"))
    everywhere = counts.groupBy("line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts")).where("n >= 4 and hosts >= 3")
    everywhere = everywhere.join(F.broadcast(total), (F.col("n") >= share * F.col("all"))).select(F.lit(None).cast("string").alias("_h"), "line")
    return own.unionByName(everywhere)


def without_content(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", host_share: float = 0.05, share: float = 0.002) -> DataFrame:
    """``key, reason`` of the documents whose content is missing.

    Null, empty and blank texts are no cases; a null host is a host of its own; every document with a
    key is judged on its whole text. Equal keys give one row.
    """
    docs = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.coalesce(F.col(host), F.lit("")).alias("_h"))
    lines = materialised(recurrent(docs, "_k", "_t", "_h", host_share, share))
    rows, kind = docs.where("_t is not null"), docs.schema["_k"].dataType.simpleString()
    common, own = frozenset(), {}
    if lines.count() <= KNOWN_LINES:
        for r in lines.groupBy("_h").agg(F.collect_set("line").alias("lines")).collect():
            own[r["_h"]] = frozenset(r["lines"])
        common = own.pop(None, common)
        rows = rows.select("_k", "_t", "_h", F.lit(None).cast("array<bigint>").alias("lines"))
    else:  # too many hosts for every worker to know them all: each text brings its host's lines along
        common = frozenset(r["line"] for r in lines.where("_h is null").select("line").collect())  # at most 1 / share times the mean number of lines
        hosts = lines.where("_h is not null").groupBy("_h").agg(F.collect_set("line").alias("lines"))
        rows = rows.join(hosts, "_h", "left").select("_k", "_t", "_h", "lines")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            why = [missing(t, Recurrent(common, own.get(h) if x is None else set(x))) for t, h, x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            found = pa.array(why, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), found], [key, "reason"]).filter(found.is_valid())

    return rows.mapInArrow(judge, f"{key} {kind}, reason string").groupBy(key).agg(F.min("reason").alias("reason"))
