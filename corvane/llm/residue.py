"""Template residue and error-page text.

Every text is cut into segments (sentences and lines outside code). A place that may be a slot (a name, an unset
value, a gap) is known by the words around it. All segments of the corpus are aligned with these places: where records
with the same surroundings are filled with values, the place is a slot, and what fills it here is residue. Whole texts
are reduced to templates, numbers and ids masked: those that recur and say what error pages say are such pages. Words
by which fields, filler and messages are told alone are seeds beside this.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.joins import lookup_join
from corvane.session import materialise

# Words of which names of template variables are made.
NAME_WORDS = frozenset(
    "address amount api app application author base body brand brief city client code color company contact content copyright country customer date day "
    "description domain email endpoint entity event feature field first fullname github handle here holder host id image insert intro item job key label last "
    "lastname license link location logo maintainer message module month name number org organisation organization owner package page password phone "
    "placeholder position price product project recipient release repo repository role sender signature street subject subtitle summary support tag team tel "
    "template text title todo tool topic url user username value vendor version web website year your zip channel".split()
)
# Words of the customary filler text.
LATIN = frozenset(
    "a ac accumsan ad adipiscing aenean aliqua aliquam aliquet amet ante arcu at auctor augue bibendum blandit commodo condimentum congue consectetur consequat "
    "convallis cras cum curabitur cursus dapibus diam dictum dignissim dis dolor dolore donec dui duis egestas eget eiusmod eleifend elementum elit enim erat "
    "eros est et etiam eu euismod ex exercitation facilisis fames faucibus felis fermentum feugiat finibus fringilla fugiat fugit fusce gravida habitant "
    "hendrerit iaculis id imperdiet in incididunt integer interdum ipsum irure justo labore laboris lacinia lacus laoreet lectus leo libero ligula lobortis "
    "lorem luctus maecenas magna malesuada massa mattis mauris maximus metus mi minim molestie mollis morbi nam nascetur nec neque nibh nisi nisl non nostrud "
    "nostrum nulla nullam nunc occaecat odio officia orci ornare pariatur pellentesque pharetra phasellus placerat porta porttitor posuere praesent pretium "
    "proin proident pulvinar purus quam quis reprehenderit rhoncus risus rutrum sagittis sapien scelerisque sed sem semper sint sit sodales sollicitudin "
    "suscipit suspendisse tellus tempor tempus tincidunt tortor tristique turpis ullamco ultrices ut varius vehicula vel velit veniam venenatis vestibulum "
    "vitae vivamus viverra voluptate volutpat vulputate".split()
)

# What unfilled fields look like. The first kinds are used for nothing else in prose; the others need a known name.
_INNER = r"\s*([A-Za-z_][\w.\- ]{0,40}?)\s*"
_STRONG = "|".join(
    (
        r"\{\{\{" + _INNER + r"\}\}\}", r"\{\{[#/&^>$]?" + _INNER + r"\}\}", r"<%[=-]?" + _INNER + r"-?%>", r"\{%-?\s*block" + _INNER + r"-?%\}(?:\{%-?\s*endblock\s*-?%\})?",
        r"#\{" + _INNER + r"\}", r"%\(" + _INNER + r"\)s", r"@@" + _INNER + r"@@", r"«" + _INNER + r"»",
        r"\[(?:(?i:your|insert|enter|add))\s" + _INNER + r"\]", r"<(?i:todo|fill in|insert|your):?\s?" + _INNER + r">", r"\[\[" + _INNER + r"\]\]",
    )
)
_WEAK = "|".join((r"\$\{" + _INNER + r"\}", r"&lt;" + _INNER + r"&gt;", r"<" + _INNER + r">", r"\{" + _INNER + r"\}", r"\$([A-Za-z_][\w. ]{0,40})\$", r"%([A-Za-z_][\w. ]{1,40})%", r"(?<![A-Za-z0-9_])__([A-Za-z][\w. ]{0,40}?)__(?![A-Za-z0-9_])"))
FIELD = re.compile(f"(?P<strong>{_STRONG})|(?P<weak>{_WEAK})")

_CODE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)|``[^\n]*?``|`[^`\n]*`|<(pre|code|script|style)\b.*?</\2>", re.S | re.M)
_QUOTE = re.compile(r"(?<!\w)[fr]?\"[^\"\n]{0,300}\"|“[^”\n]{0,300}”")
_TAG = re.compile(r"</?(?:h[1-6]|p|hr|br|div|span|noscript|body|html|center|title|strong|b|em|main|section)\b[^<>]{0,80}/?>", re.I)
_LEAD = re.compile(r"^(?:\s|//+|/?\*+/?|#+(?=\s|$)|>+|[-•](?=\s)|--+|;+|\d+[.)]\s)+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"')\]]*\s+|(?<=[。！？])")
_MASK = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+")
#: A line that is code although nothing marks it as such. Words that also begin sentences need more than a bracket or colon: a call, a block, an assignment or a path of their kind.
_CODELIKE = re.compile(
    r"^\s*(?:(?:pub(?:\(\w+\))?\s+)?(?:fn|def|func|struct|impl|enum|const|var|#include|cp|mv|echo|cd|sudo|curl|git|npm|pip|cargo)\b.*[(){};=$/<>:]"
    r"|(?:pub(?:\(\w+\))?\s+)?(?:function|class|import|from|export|let|return|if|for|while|use|select|insert|update)\b(?:\s*\(|.*(?:\w\(|[{}=$<>]|::|;\s*$|:\s*$|:\s+(?:return|continue|break|pass|raise|yield|print|assert|del|throw)\b))"
    r"|(?:import|from|use|export)\s+[.@]?[\w-]*/\S*(?:\s|$)|(?:let|export|class)\s+\w+\s*:|(?:update\s+\S+\s+set|insert\s+into\s+\S+\s+(?:values|select))\b|select\b.*\bfrom\s+\S+\s+(?:where|join|group|order|limit)\b|return\s+§$"
    r"|[\w.\[\]]+\s*[-+*/]?=[^=].*[;)\]]?$|\||@\w+\(|\}|\{$)",
    re.I,
)
#: Code whose own signs look like fields: commands of a shell, names taken from a module.
_OWN_SIGNS = re.compile(r"^\s*(?:(?:cp|mv|echo|cd|sudo|curl|git|npm|pip|cargo|export|set)\b.*(?:\$|<[^<>]*>)|(?:import|export)\s+(?:type\s+)?(?:\w+\s*,\s*)?\{[^{}]*\}\s*(?:from\b|;|$))")

_S = r"(?:^|[:\-–|]\s+|^[^\w]*(?:oops|sorry|we're sorry|désolé|oups|leider|hoppla|lo sentimos|¡?vaya)[!.:,]?\s+)"
_HTTP = r"bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|payload too large|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out"
#: Sentences of error pages, by language.
ERROR_SAYINGS = (
    rf"^(?:http |error |error code:? ?|status:? ?|fehler |erreur |código de error:? ?)?[45]\d\d\s*[-:–]?\s*(?:{_HTTP})\b",
    r"^(?:http(?:/\d(?:\.\d)?)?|error(?: code)?|status|fehler|erreur|código de error|statut):?\s+[45]\d\d(?:\s*$|\s*[-:–.])",
    rf"^(?:{_HTTP})[.!]?$",
    r"(?:^|[:–-] |sorry[,.] |oops! )(?:the|this|that|your|our) (?:[\w'-]+ ){1,6}?(?:could not be (?:found|loaded|displayed|reached|completed|processed)|cannot be (?:found|displayed|reached)|can't be (?:found|displayed|reached)|does(?: not|n't) exist any ?more|no longer exists|(?:was|has been) (?:moved or (?:removed|deleted)|blocked by an? [\w ]{1,20}rule)|is over its \w+ quota|timed out\b(?! (?:and|before|when))|has (?:expired|timed out)\b|returned an unexpected error|needs you to sign in|requires you to sign in|is (?:temporarily|currently) unavailable|is not available (?:right now|at the moment)|took too long to (?:answer|respond)|is down for (?:scheduled )?maintenance)",
    r"(?:^|[:–-] |sorry[,.] |oops! )(?:we are|we're|the (?:site|service|server) is) down for (?:scheduled )?maintenance\b", r"(?:^|[:–-] |sorry[,.] |oops! )your connection (?:was|has been) (?:refused|reset|interrupted|closed)\b",
    r"^(?:please )?try again later[.!]?$", r"^retry after \d+ seconds[.!]?$", r"^if this keeps happening, contact\b", r"^go back to the (?:start|home) ?page[.!]?$", r"^sign in to continue[.!]?$", r"^request id: [0-9a-f-]{6,}$",
    r"^(?:veuillez réessayer plus tard|retour à l'accueil|bitte versuchen sie es später erneut|zurück zur startseite|inténtelo de nuevo más tarde|volver al inicio)[.!]?$",
    r"\byou (?:do not|don't) have (?:permission|access)\b[^.]{0,30}\b(?:view|access|see|open)?\b", r"\btoo many requests\b[^.]{0,30}\b(?:from your|were sent)", r"\bsomething went wrong(?: on our (?:end|side))?\b", r"\ban unexpected (?:condition|error) (?:kept|prevented|occurred|has occurred)\b",
    r"(?:^|[:–-] |sorry[,.] |oops! )(?:la|cette|ce|le|cet|votre|notre|l'\w+) (?:[\w'-]+ ){0,5}?(?:est introuvable|n'existe (?:plus|pas)|n'est pas disponible|est (?:momentanément |temporairement |actuellement )?indisponible|a été (?:déplacée?|supprimée?|bloquée?)|a expiré|n'a pas (?:pu être|été) (?:trouvée?|chargée?))",
    r"\bvotre (?:session|demande|requête) (?:a expiré|a été bloquée)", r"\baccès (?:refusé|interdit)\b", r"\btrop de requêtes\b", r"\berreur interne du serveur\b", r"\bune erreur (?:inattendue )?(?:est survenue|s'est produite)\b", r"\bvous n'avez pas (?:la permission|l'autorisation|le droit)\b",
    r"(?:^|[:–-] |sorry[,.] |oops! )(?:die|diese[rs]?|das|der|ihre?|unsere?) (?:[\wäöüß-]+ ){0,5}?(?:wurde (?:nicht gefunden|blockiert|verschoben oder gelöscht|gelöscht|entfernt)|konnte nicht (?:geladen|gefunden|angezeigt)|ist (?:derzeit |zurzeit |momentan |vorübergehend )?nicht (?:verfügbar|erreichbar)|existiert nicht(?: mehr)?|ist abgelaufen)",
    r"\bihre (?:sitzung|anfrage) (?:ist abgelaufen|wurde blockiert|konnte nicht)", r"\bzugriff verweigert\b", r"\bzu viele anfragen\b", r"\binterner serverfehler\b", r"\bein (?:unerwarteter )?fehler ist aufgetreten\b",
    r"(?:^|[:–-] |sorry[,.] |oops! )(?:la|esta|el|este|su|nuestr[oa]) (?:[\wáéíóúñ-]+ ){0,5}?(?:no se (?:ha encontrado|encuentra|encontró|ha podido cargar|pudo cargar)|ya no existe|no está disponible|(?:ha sido|fue) (?:bloquead|movid|eliminad)[oa]|se ha (?:movido|eliminado|bloqueado)|ha (?:caducado|expirado))",
    r"\bsu sesión ha (?:caducado|expirado)", r"\bno se ha encontrado la página\b", r"\bacceso denegado\b", r"\bdemasiadas (?:solicitudes|peticiones)\b", r"\berror interno del servidor\b", r"\bse ha producido un error\b",
    r"^(?:ページが見つかりません|アクセスが拒否されました|内部サーバーエラー|お探しのページ)",
)
#: Demands for scripts, cookies or a check of the browser, by language.
SCRIPT_SAYINGS = (
    r"^(?:please |you (?:need|have|must) (?:to )?|to (?:view|use) [^.,]{1,60}, )?(?:enable|turn on|switch on|activate|allow) (?:javascript|java script|scripts|scripting|cookies|active content)\b",
    r"^(?:javascript|java script|scripts?|scripting|active content|cookies?) (?:is|are|must be|has been|have been) (?:currently )?(?:required|needed|necessary|disabled|blocked|turned off|switched off|off|enabled)\b",
    r"^(?:this|our|the) (?:site|page|app|application|view|viewer|website|document)\b[^.]{0,20}\b(?:needs|requires) (?:javascript|scripts|scripting|cookies|active content)\b", r"^your browser (?:has|does not|doesn't|blocks)\b[^.]{0,40}\b(?:javascript|scripts|scripting|cookies)\b", r"^loading\.\.\.|\bif nothing happens, (?:switch|turn) on (?:scripts|javascript)\b",
    r"^allow (?:it|them) for this site\b", r"^turn them on in your browser settings\b", r"^accept (?:all )?cookies\b", r"^we use cookies\b", r"^(?:please )?(?:verify|confirm|prove) (?:that )?you are (?:a )?(?:human|not a robot)\b", r"^checking (?:your browser|if the site connection is secure)\b", r"^(?:are you|i am|i'm not) a? ?(?:robot|human)\b", r"^complete the (?:captcha|security check)\b",
    r"^(?:veuillez |merci d')?activer (?:javascript|les scripts|les cookies)\b", r"^(?:javascript|l'exécution de scripts|les scripts|le contenu actif|les cookies) (?:est|sont|doi(?:t|vent))\b", r"^cette (?:vue|page|application) (?:a besoin de|nécessite|requiert)\b[^.]{0,20}\b(?:scripts|javascript|cookies)\b", r"^confirmez que vous n'êtes pas un robot\b", r"^(?:vérification|contrôle) de votre navigateur\b",
    r"^(?:bitte )?aktivieren sie (?:javascript|skripte|cookies)\b", r"^(?:javascript|(?:die )?skriptausführung|skripte|aktive inhalte|cookies) (?:ist|sind|wird|werden|muss|müssen)\b", r"^(?:diese|die) (?:ansicht|seite|anwendung) (?:braucht|benötigt|erfordert) (?:skripte|javascript|cookies)\b", r"^(?:bitte )?bestätigen sie, dass sie kein roboter sind\b", r"^(?:ihr )?browser wird (?:über)?geprüft\b",
    r"^(?:por favor, )?(?:active|activa|habilite|habilita|permita) (?:javascript|los scripts|las cookies)\b", r"^(?:javascript|la ejecución de scripts|los scripts|el contenido activo|las cookies) (?:está|están|es|son|debe|deben)\b", r"^esta (?:vista|página|aplicación) (?:necesita|requiere)\b[^.]{0,20}\b(?:scripts|javascript|cookies)\b", r"^confirme que no es un robot\b", r"^(?:comprobando|verificando) su navegador\b",
    r"^(?:javascriptを有効|クッキーを有効|ロボットではない)",
)
#: Words that stand where content should be filled in.
FILLER_SAYINGS = (
    r"\bonly here to fill the page\b", r"^sample text\b[^.]{0,30}\breplaced\b", r"^your (?:own )?text (?:goes )?here\b", r"^body copy to come\b", r"^replace this text\b", r"^add a (?:short )?description\b[^.]{0,40}\bhere\b", r"^describe (?:the|your) \w+ here\b", r"^(?:insert|type|enter|write) (?:your )?(?:text|content|title|description) here\b", r"^content (?:goes here|to come|coming soon)\b",
    r"^untitled(?: \d+)?$", r"^coming soon[.!]?$", r"\(no description provided\)", r"\(replace me\)", r"^(?:tbd|todo|tba|fixme|xxx)(?:[\s.,]+(?:tbd|todo|tba|fixme|xxx))+\W*$", r"^(?:fixme|todo|tbd):?\s+(?:write|describe|add|fill|complete) (?:this|the|a|in)\b", r"^(?:this is )?(?:dummy|placeholder|filler) text\b", r"^(?:owner|reviewers?|author|date|contact)\s*:\s*\?{2,}$", r"<fill in>|\[fill in\]",
    r"^your (?:[\w-]+ ){1,3}(?:title|subtitle|heading|headline|tagline)$", r"\bmissing (?:translation for|string:)", r"\bgoes here\b", r"^\((?:to be (?:written|added|done|completed)|write|describe|add|insert|fill in) ?[^()]*\)$", r"(?:^|[:\s])(?:_{4,}|_{2}/_{2}/_{2,4})(?:$|[\s.,;])", r"^(?:posted|written|created|published|edited|updated)\b by  +on  +", r"\binvalid date\b", r"^(?:dear|hello|hi|hallo|bonjour|hola) (?:none|null|undefined|nan)\b", r"^(?:su|tu) texto aquí\b", r"^texto de (?:ejemplo|muestra|relleno)\b", r"^votre texte ici\b", r"^texte (?:d'exemple|de remplissage|factice)\b", r"\bsteht nur blindtext\b", r"^(?:muster|blind|beispiel)text\b[^.]{0,30}\b(?:ersetzen|hier)\b", r"^(?:[\w-]+ [-–] )?(?:unter|über)?(?:schrift|titel) hier (?:eingeben|einfügen)\b", r"^(?:ihr|dein) text hier\b", r"^(?:ここにテキスト|サンプルテキスト|ダミーテキスト)",
)
_LEXICON = {"error": re.compile("|".join(f"(?:{p})" for p in ERROR_SAYINGS), re.I), "scripts": re.compile("|".join(f"(?:{p})" for p in SCRIPT_SAYINGS), re.I), "filler": re.compile("|".join(f"(?:{p})" for p in FILLER_SAYINGS), re.I)}
# Pieces of text, in lower case, of which every saying above has one. Lines with none of them are passed over.
TRIGGERS = {
    "error": (
        "request", "authori", "payment", "forbidden", "found", "not allowed", "not acceptable", "conflict", "gone", "payload", "too many", "server error", "implemented", "gateway", "unavailable", "http", "error", "status", "fehler", "erreur", "statut",
        "be loaded", "be displayed", "be reached", "be completed", "be processed", "exist", "was moved", "been moved", "removed", "deleted", "blocked", "been disabled", "was disabled", "quota", "timed out", "time-out", "timeout", "expired", "to sign in", "not available", "permission", "have access", "went wrong", "unexpected",
        "introuvable", "disponible", "indisponible", "maintenance", "too long", "connection", "try again", "retry", "keeps happening", "start page", "home page", "startpage", "homepage", "sign in", "réessayer", "accueil", "später", "startseite", "de nuevo", "inicio", "a été", "expiré", "n'a pas", "bloquée", "accès", "trop de", "une erreur", "vous n'avez",
        "wurde nicht", "blockiert", "verschoben", "gelöscht", "entfernt", "konnte nicht", "nicht verfügbar", "nicht erreichbar", "abgelaufen", "zugriff", "zu viele", "serverfehler",
        "no se", "encontr", "caducado", "expirado", "ha sido", "fue ", "acceso", "demasiadas", "se ha", "見つかりません", "拒否", "サーバーエラー", "お探し",
    ),
    "scripts": ("script", "cookie", "active content", "aktive inhalte", "contenu actif", "contenido activo", "for this site", "site connection", "browser", "robot", "human", "captcha", "security check", "loading...", "skript", "navigateur", "navegador", "クッキー", "ロボット"),
    "filler": (
        "fill the page", "sample text", "text here", "text goes here", "own text", "body copy", "replace this", "replace me", "description", "here", "untitled", "coming soon", "to come", "tbd", "todo", "tba", "fixme", "xxx", "dummy", "placeholder", "filler", "??", "fill in", "title", "heading", "headline", "tagline", "translation", "texto", "texte", "blindtext", "mustertext", "beispieltext", "hier", "テキスト", "missing string", "to be ", "(write", "(describe", "(add", "(insert", "____", "__/__", "invalid date", "dear ", "hello ", "hi ", "hallo ", "bonjour ", "hola ", " by  on ", "bla bla", "asdf",
    ),
}
_FIELD_SIGNS = ("{", "<", "[", "%", "@@", "__", "«", "&lt;", "$")
_DEFAULT_SIGNS = ("undefined", "null", "none", "nan", "nil", "[object", "00/00")


def _automaton():
    """One pass over a line tells which kinds it may be."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for kind, words in TRIGGERS.items():
        for w in words:
            kinds.setdefault(w, set()).add(kind)
    for i, words in enumerate(PAGE_TRIGGERS):
        for w in words:
            kinds.setdefault(w, set()).add(f"page:{i}")
    for w in _DEFAULT_SIGNS:
        kinds.setdefault(w, set()).add("default")
    for w in LATIN:
        if len(w) >= 4:
            kinds.setdefault(w, set()).add("latin:" + w)
    for w, k in kinds.items():
        machine.add_word(w, tuple(k))
    machine.make_automaton()
    return machine


_machines: list = []


def _hints(low: str) -> set[str]:
    if not _machines:
        _machines.append(_automaton())
    out: set[str] = set()
    for _, kinds in _machines[0].iter(low):
        out.update(kinds)
    return out


_APOLOGY = re.compile(r"^(?:oops|sorry|we're sorry|we are sorry|désolée?|oups|leider|entschuldigung|hoppla|lo sentimos|¡?vaya)\s*[!.:,]\s*", re.I)
_DEFAULT = re.compile(r"\[object Object\]|(?<![\w`'\"/.])(?:undefined|null|None|NaN|nil)(?![\w`'\"(])|NaN/NaN|00/00/0000")
# What a page is asked for, what became of it and regrets, by language (en, fr, de, es, it, pt, nl, ru, ja).
_THING = r"(?:access|request|connection|page|website|site|session|visit|address|account|resource|document|file|server|service|link|zugriff|anfrage|verbindung|webseite|seite|sitzung|adresse|konto|datei|dokument|dienst|accès|requête|connexion|ressource|fichier|serveur|lien|acceso|solicitud|conexión|página|sitio|sesión|recurso|archivo|servidor|enlace|accesso|richiesta|connessione|pagina|sito|sessione|risorsa|acesso|pedido|conexão|sessão|toegang|verzoek|verbinding|sessie|bestand|страница|доступ|запрос|ページ|アクセス|リクエスト)"
_FAILED = r"(?:denied|blocked|refused|forbidden|expired|timed out|unavailable|rejected|interrupted|reset|restricted|suspended|not found|no longer (?:exists|available)|(?:has|have|was|were) (?:been )?(?:moved|removed|deleted)|verweigert|blockiert|gesperrt|abgelaufen|umgezogen|verschoben|gelöscht|entfernt|unterbrochen|nicht (?:gefunden|verfügbar|erreichbar)|refusée?|bloquée?|interdite?|expirée?|introuvable|indisponible|supprimée?|déplacée?|denegad[oa]|bloquead[oa]|caducad[oa]|expirad[oa]|eliminad[oa]|no (?:encontrad[oa]|disponible)|negat[oa]|bloccat[oa]|scadut[oa]|rimoss[oa]|spostat[oa]|non (?:trovat[oa]|disponibile)|negad[oa]|removid[oa]|não (?:encontrad[oa]|disponível)|geweigerd|geblokkeerd|verlopen|verplaatst|verwijderd|niet (?:gevonden|beschikbaar)|не найден[ао]?|запрещ[её]н[ао]?|見つかりません|拒否|できません)"
_REGRET = r"\b(?:sorry|apologi[sz]e|apologies|unfortunately|oops|leider|entschuldig\w+|désolés?|malheureusement|lo sentimos|lamentablemente|purtroppo|spiacenti|infelizmente|desculpe|helaas|к сожалению)\b|申し訳"
#: What error and block pages say somewhere, by kind; two kinds, or one and a status number, are evidence for a page that recurs.
PAGE_SIGNS = (
    rf"(?<!\w){_THING}(?!\w)[^.!?/]{{0,60}}(?<!\w){_FAILED}(?!\w)|ページ[^。]{{0,20}}(?:見つかりません|できません)|アクセス[^。]{{0,20}}拒否",
    r"\b(?:unusual|suspicious|automated|malicious) (?:traffic|activity|requests?|behaviou?r)\b|\bungewöhnliche[nr]? (?:datenverkehr|aktivität)|\btrafic inhabituel|\btráfico inusual|\btraffico (?:insolito|anomalo)",
    r"\b(?:ray|request|incident|reference|event|support|error|trace|correlation|session|vorgangs|anfrage) ?-?(?:id|code|nummer|number)\b\s*[:#=]|\bcorrelation id\b|\b(?:incident|reference|referenz|référence|referencia|riferimento|referência|vorgang|ticket)\b\s*[:#=]?\s*#?(?=[\w-]*\d)[\w-]+",
    r"\b(?:protected by|uses?|triggered|by) (?:an? |our |the |its )?(?:\w+ )?(?:security (?:service|solution|system|rules?|policy|check)|firewall)\b|\bprotect (?:itself|our \w+|the \w+) (?:from|against)\b",
    r"\btry(?:ing)? again\b|\breload (?:the|this) page\b|\bcome back later\b|\bversuchen sie es\b[^.]{0,30}\berneut\b|\bréessayer\b|\binténtelo de nuevo\b|\briprova(?:re)?\b|\btente novamente\b|\bprobeer het\b[^.]{0,20}\bopnieuw\b",
    r"\b(?:contact|email|notify|tell|inform) (?:the|your|our|this) (?:\w+ ){0,2}(?:owner|administrators?|webmaster|support|help ?desk)\b",
    r"\b(?:temporarily|currently) (?:unavailable|down|offline|out of service|unable)\b|\bwent wrong\b|\binternal server error\b|\bunexpected error\b|\b(?:could not|cannot|unable to) (?:be )?(?:process|complete|fulfil|serve|display|load)",
    _REGRET,
)
_PAGE_SIGNS = tuple(re.compile(p, re.I) for p in PAGE_SIGNS)
# Pieces of text, in lower case, of which each of these kinds has one.
PAGE_TRIGGERS = (
    ("denied", "blocked", "refused", "forbidden", "expired", "timed out", "unavailable", "rejected", "interrupted", "reset", "restricted", "suspended", "not found", "no longer", "moved", "removed", "deleted", "verweigert", "blockiert", "gesperrt", "abgelaufen", "umgezogen", "verschoben", "gelöscht", "entfernt", "unterbrochen", "nicht gefunden", "nicht verfügbar", "nicht erreichbar", "refusé", "bloqu", "interdit", "expiré", "introuvable", "indisponible", "supprimé", "déplacé", "denegad", "caducad", "expirad", "eliminad", "no encontrad", "no disponible", "negat", "bloccat", "scadut", "rimoss", "spostat", "non trovat", "non disponibile", "negad", "removid", "não encontrad", "não disponível", "geweigerd", "geblokkeerd", "verlopen", "verplaatst", "verwijderd", "niet gevonden", "niet beschikbaar", "не найден", "запрещ", "見つかりません", "拒否", "できません"),
    ("unusual", "suspicious", "automated", "malicious", "ungewöhnliche", "inhabituel", "inusual", "insolito", "anomalo"),
    ("id:", "id :", "id #", "id#", "id=", "id =", "code:", "code :", "code #", "code#", "code=", "code =", "number:", "number :", "number #", "number#", "number=", "number =", "nummer", "correlation id", "incident", "reference", "referen", "référence", "riferimento", "referência", "vorgang", "ticket"),
    ("security", "firewall", "protect"),
    ("again", "reload", "come back", "erneut", "réessayer", "de nuevo", "riprova", "novamente", "opnieuw"),
    ("owner", "administrator", "webmaster", "support", "help desk", "helpdesk"),
    ("temporarily", "currently", "went wrong", "server error", "unexpected error", "could not", "cannot", "unable to"),
    ("sorry", "apolog", "unfortunately", "oops", "leider", "entschuldig", "désolé", "malheureusement", "lo sentimos", "lamentablemente", "purtroppo", "spiacenti", "infelizmente", "desculpe", "helaas", "к сожалению", "申し訳"),
)
_STATUS = re.compile(r"(?<![\w.-])[45]\d\d(?![\w-]|\.\w)")
_WORD = re.compile(r"[^\W\d_]+")
#: Words joined as in names of variables; two blanks where a word was taken out.
_JOINED = re.compile(r"(?<![\w./$-])[A-Za-z]+(?:_[A-Za-z]+)+(?![\w./(-])|(?<![\w./$-])(?:[a-z]+|[A-Z][a-z]+)(?:[A-Z][a-z]+)+(?![\w./(-])")
#: Words and single signs, and what is masked before they are cut: words with digits, for which a 0 stands.
_TOKEN, _MASKED = re.compile(r"\w+|[^\w\s]"), re.compile(r"\b[^\W\d]*+\d\w*")
#: Where the sentences of a line end.
_ENDS = re.compile(r"([.!?][\"')\]]*)\s+")
_HUMP = re.compile(r"[a-z][A-Z]|[A-Za-z]_[A-Za-z]")
_GAP_SIGNS = ("  ", " ,", " !", " .")
_GAP = re.compile(r"(?<=[A-Za-z:,])  (?=[A-Za-z,.])|(?<=[A-Za-z]) (?=[,!.](?:\s|$))")


def name_parts(name: str) -> list[str]:
    """The words of a variable name, whatever joins them."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def known_name(name: str) -> bool:
    """Whether most words of a name are such as template variables are made of."""
    parts = [p for p in name_parts(name) if not p.isdigit()]
    return bool(parts) and 2 * sum(p in NAME_WORDS for p in parts) > len(parts)


def prose_lines(text: str) -> Iterator[str]:
    """The lines of a text without code, quotes and mark-up."""
    bare = _CODE.sub(" ", text) if "`" in text or "~~~" in text or "<" in text else text
    for line in re.split(r"\r\n|[\n\r\x0b\x0c\x85  ]", bare):
        line = line.strip()
        if not line:
            continue
        if line.startswith('{"') and line.endswith("}"):
            try:
                body = json.loads(line)
                said = next((str(body[k]) for k in ("message", "error", "detail", "title") if isinstance(body.get(k), str)), None)
            except (ValueError, AttributeError):
                said = None
            if said is not None:
                yield said
                continue
        yield line


def segments(line: str) -> Iterator[tuple[str, bool]]:
    """(segment, whole line or not): tags taken away, marks of lists and comments too."""
    for part in _TAG.split(line) if "<" in line else (line,):
        part = _LEAD.sub("", part).strip()
        if not part:
            continue
        yield part, True
        pieces = [p.strip() for p in _SENTENCE.split(part)]
        if len(pieces) > 1:
            yield from ((p, False) for p in pieces if p)


def codelike(line: str) -> bool:
    """Whether a line is code by signs of its own; those of fields and unset values tell nothing."""
    return bool(_OWN_SIGNS.match(line) or _CODELIKE.match(_DEFAULT.sub("§", FIELD.sub("§", line))))


def template_of(segment: str) -> str:
    """A segment with marks for fields, numbers and ids: records of one template have the same."""
    return re.sub(r"\s+", " ", _MASK.sub("#", FIELD.sub("§", segment))).strip().lower()


def inspect(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, template, name) of what may be residue: fields, defaults, filler, error or scripts.

    A field comes with the name it shows; `field?` means that the name alone does not tell. `page?` is
    a text that may be an error page as a whole; its template is hashed, its name is a hash of the text, or
    empty if the page itself says so.
    """
    return [row for row in spotted(text) if row[0] != "slot?"]


def spotted(text: str | None) -> list[tuple[str, str, str]]:
    """What `inspect` gives and `slot?`: what stands before and behind a name, an unset value or a gap, with a tab between, and as its name the kind."""
    if not text:
        return []
    found = []
    seen: set[str] = set()
    lines = []
    for line in prose_lines(text):
        hints = _hints(line.lower())
        seen |= hints
        lines.append(line)
        signs = any(sign in line for sign in _FIELD_SIGNS)
        latin = sum(h[:6] == "latin:" for h in hints) >= 3 or {"latin:lorem", "latin:ipsum"} <= hints
        kinds = [k for k in _LEXICON if k in hints]
        first = line.split(None, 4)[:4]
        if len(first) == 4 and first[0].isalpha() and len(set(first)) == 1:
            found.append(("filler", "one word again and again", ""))
        # Where code was taken out of a line, its gaps are ours.
        gaps = any(x in line for x in _GAP_SIGNS) and bool(_GAP.search(line)) and line in text
        if signs or "default" in hints or gaps or (_HUMP.search(line) and _JOINED.search(line)):
            for segment in finest(line):
                found += _slots(segment, gaps)
        if not (signs or latin or kinds or "default" in hints):
            continue
        for segment, whole in segments(line):
            bare = _QUOTE.sub(" ", segment) if '"' in segment or "“" in segment else segment
            probe = _APOLOGY.sub("", bare)
            for kind in kinds:
                if _LEXICON[kind].search(probe):
                    found.append((kind, template_of(bare), ""))
            if not (whole and (signs or "default" in hints)) and not latin or codelike(bare):
                continue
            if latin and _latin(bare):
                found.append(("filler", "latin", ""))
            if not whole:
                continue
            if signs:
                found += _fields(bare)
            if "default" in hints and (len(_DEFAULT.findall(bare)) >= 2 or "[object Object]" in bare or "NaN/NaN" in bare):
                found.append(("default", template_of(bare), ""))
    likely = sum(h[:5] == "page:" for h in seen)
    status = bool(_STATUS.search(text))
    if status and "error" in seen or likely + status >= 2:
        page = " / ".join(lines)
        template = hashlib.md5(template_of(page).encode("utf-8", "replace")).hexdigest()
        status = bool(_STATUS.search(page))
        may = [r for i, r in enumerate(_PAGE_SIGNS) if f"page:{i}" in seen]
        kinds = sum(bool(r.search(page)) for r in may)
        # How often the text says so, against its sentences: a page that is more than its message tells it once in four of them.
        pieces = [p for line in lines for p in finest(line)]
        if status and "error" in seen:
            said = sum(bool(_STATUS.search(x)) or "error" in _hints(x.lower()) for x in pieces)
            if 4 * said >= len(pieces):
                found.append(("page?", template, hashlib.md5(text.encode("utf-8", "replace")).hexdigest()))
        if kinds and kinds + status >= 2:
            said = sum(any(r.search(x) for r in may) for x in pieces)
            if 4 * said >= len(pieces):
                found.append(("page?", template, ""))
    return list(dict.fromkeys(found))


def _latin(segment: str) -> bool:
    """Whether a segment is filler of Latin words; fewer of them do where it begins as the filler does."""
    words = _WORD.findall(segment.lower())
    hits = sum(w in LATIN and len(w) > 2 for w in words)
    return (hits >= 4 or words[:2] == ["lorem", "ipsum"]) and hits >= 0.7 * len(words)


def finest(line: str) -> Iterator[str]:
    """The sentences of a line, or its parts where they have only one, without quotes and code."""
    for part in _TAG.split(line) if "<" in line else (line,):
        part = _LEAD.sub("", part).strip()
        for piece in _SENTENCE.split(part) if part else ():
            bare = _QUOTE.sub(" § ", piece) if '"' in piece or "“" in piece else piece
            if bare and not codelike(bare):
                yield bare


def words_of(segment: str) -> list[str]:
    """Words and signs of a segment in lower case, words with digits masked, without signs that lead it."""
    return _without_lead(_TOKEN.findall(_MASKED.sub("0", segment).lower()))


def _without_lead(words: list[str]) -> list[str]:
    if words and not (words[0][0].isalnum() or words[0][0] == "_"):
        first = next((i for i, w in enumerate(words) if w[0].isalnum() or w[0] == "_"), len(words))
        return words[first:]
    return words


def _segments_of(text: str) -> list[str]:
    """The sentences of all lines."""
    if "。" in text or "！" in text or "？" in text:
        text = text.replace("。", "。\n").replace("！", "！\n").replace("？", "？\n")
    return _ENDS.sub(r"\1\n", text).splitlines()


def _slots(segment: str, gaps: bool) -> Iterator[tuple[str, str, str]]:
    """What stands around each place that names, defaults or nothing fill: two words before, two behind and all others."""
    places = [(m.start(), m.end(), "default") for m in _DEFAULT.finditer(segment)]
    for m in FIELD.finditer(segment):
        name = next((g for g in m.groups() if g and g != m[0]), "")
        if m["weak"] and not (m[0][0] == "<" and (segment[m.start() - 1 : m.start()][-1:].isalnum() or name.lower() in _HTML)):
            places.append((m.start(), m.end(), "field " + "".join(name_parts(name))))
    if not places:
        places = [(m.start(), m.end(), "field " + "".join(name_parts(m[0]))) for m in _JOINED.finditer(segment) if known_name(m[0])]
        places += [(m.start() + 1, m.end() - 1, "default") for m in _GAP.finditer(segment) if gaps]
    for start, end, what in places:
        before = words_of(FIELD.sub(" ", segment[:start]))[-NEAR:]
        # Signs behind a slot are no marks of a list.
        after = words_of("x " + FIELD.sub(" ", segment[end:]))[1 : NEAR + 1]
        told = [w for w in before + after if w[0].isalpha()]
        if len(told) >= 2 or before[-1:] == [":"]:
            left, right = (["^", "^", *before])[-2:], ([*after, "$", "$"])[:2]
            yield "slot?", "\t".join((" ".join(left), " ".join(right), " ".join(dict.fromkeys(before + after)))), what


def _fields(bare: str) -> Iterator[tuple[str, str, str]]:
    template = None
    for m in FIELD.finditer(bare):
        name = next((g for g in m.groups() if g and g != m[0]), "")
        if m["weak"] and m[0][0] == "<":
            before = bare[m.start() - 1 : m.start()]
            # A type argument such as List<T> is no field, nor is mark-up.
            if (before and (before.isalnum() or before in "_>:.&")) or name.lower() in _HTML:
                continue
        template = template or template_of(bare)
        yield "field" if m["strong"] or known_name(name) else "field?", template, "".join(name_parts(name))


#: Names of mark-up elements.
_HTML = frozenset("a abbr article aside audio b base blockquote body br button canvas caption center cite code col dd del details div dl dt em embed fieldset figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead title tr track u ul var video wbr".split())


def candidates(df: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """doc_id, kind, template, name of everything that may be residue. Null and blank texts give nothing."""
    kept = df.select(doc_id.alias("doc_id"), text.alias("text")).where("text is not null and doc_id is not null")
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1)):
                for row in spotted(value.as_py()):
                    at.append(i)
                    rows.append(row)
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=["doc_id", "kind", "template", "name"])

    return kept.mapInArrow(run, f"doc_id {kind}, kind string, template string, name string")


#: Words that fill a slot at most; longer text between two pieces that recur is no value.
FILL_WORDS = 4
#: Words on either side of a slot that are compared, and the share of them that an aligned record has too; the others are slots of their own.
NEAR, ALIKE = 64, 0.6
#: Bits of a filter of surroundings, which is sent to all tasks: it only saves rows, the join behind it is exact.
FILTER_BITS = 1 << 22


def _filter(slots: DataFrame, value: Column) -> bytes:
    """A filter with the bits set that hashes of `value` name; at most FILTER_BITS numbers are collected, however many slots there are."""
    import numpy as np

    bits = np.zeros(FILTER_BITS, bool)
    found = slots.select(F.xxhash64(value).bitwiseAND(FILTER_BITS - 1).cast("int").alias("bit")).distinct().toArrow()
    bits[found.column("bit").to_numpy()] = True
    return bits.tobytes()


class _Filter:
    """Tells whether a text may be among those of a filter; remembers what it told of the last many."""

    def __init__(self, bits: bytes) -> None:
        self.bits, self.told = bits, {}

    def ask(self, value: str) -> bool:
        import xxhash

        if len(self.told) > 500_000:
            self.told.clear()
        out = self.told[value] = bool(self.bits[xxhash.xxh64_intdigest(value.encode("utf-8", "replace"), 42) & (FILTER_BITS - 1)])
        return out


def aligned(text: str, lefts: _Filter, pairs: _Filter) -> Iterator[tuple[str, str, str, str]]:
    """(two words before, two behind, fill, words near by) of all places of a text whose surroundings may be those of slots."""
    known, ask = lefts.told, lefts.ask
    raws: list[str] | None = None
    lows = _segments_of(_MASKED.sub("0", text).lower())
    for at, segment in enumerate(lows):
        low = _without_lead(_TOKEN.findall(segment))
        if len(low) < 2:
            continue
        one, two = "^", "^"
        for i, word in enumerate(low):
            left = f"{one} {two}"
            one, two = two, word
            may = known.get(left)
            if not (ask(left) if may is None else may):
                continue
            for n in range(1, min(FILL_WORDS, len(low) - i) + 1):
                right = " ".join((low[i + n : i + n + 2] + ["$", "$"])[:2])
                pair = left + "\t" + right
                may = pairs.told.get(pair)
                if pairs.ask(pair) if may is None else may:
                    raws = _segments_of(text) if raws is None else raws
                    raw = _without_lead(_TOKEN.findall(raws[at])) if len(raws) == len(lows) else low
                    raw = raw if len(raw) == len(low) else low
                    yield left, right, " ".join(raw[i : i + n]), " ".join(low[max(0, i - NEAR) : i] + low[i + n : i + n + NEAR])


def record_slots(slots: DataFrame, df: DataFrame, doc_id: Column, text: Column, least_records: int = 3) -> DataFrame:
    """Of `slots` (template, as `_slots` gives it) those that records fill: at least `least_records` other texts have
    differing values, mostly names, numbers or addresses, between the same two words before and behind, and
    `ALIKE` of the other words near by.

    All segments of the corpus are aligned with all slots by equality of the words around a place of 1 to `FILL_WORDS`
    words. Filters of a fixed size leave few places to be joined.
    """
    part = F.split("template", "\t")
    keyed = materialise(slots.select("template").distinct().select("template", part[0].alias("left"), part[1].alias("right"), F.split(part[2], " ").alias("others")))
    context = df.sparkSession.sparkContext
    known = context.broadcast((_filter(keyed, F.col("left")), _filter(keyed, F.concat_ws("\t", "left", "right"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, pairs = map(_Filter, known.value)
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1)):
                for row in aligned(value.as_py(), lefts, pairs):
                    at.append(i)
                    rows.append(row)
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=["doc_id", "left", "right", "fill", "near"])

    read = df.select(doc_id.alias("doc_id"), text.alias("text")).where("text is not null and doc_id is not null")
    places = read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, left string, right string, fill string, near string")
    same = lookup_join(places, keyed, ["left", "right"], salt_on=["doc_id", "fill"])
    filled = same.where(F.size(F.array_intersect("others", F.split("near", " "))) >= ALIKE * F.size("others"))
    # Names of variables, unset values and fields fill a slot too, but are no values.
    plain = filled.where(F.col("fill").rlike(r"[\p{L}\p{N}]") & ~F.col("fill").rlike(r"[{}<>$%@\[\]]{1}\s*[A-Za-z_]") & ~F.col("fill").rlike(_DEFAULT_FILL) & ~F.col("fill").rlike(r"^[A-Za-z]+(_[A-Za-z]+)+$|^([a-z]+|[A-Z][a-z]+)([A-Z][a-z]+)+$"))
    value = F.col("fill").rlike(r"^\p{Lu}|\p{Nd}|@|: / /").cast("int")
    counted = plain.groupBy("template").agg(F.approx_count_distinct("doc_id").alias("texts"), F.approx_count_distinct("fill").alias("fills"), F.avg(value).alias("values"))
    return counted.where((F.col("texts") >= least_records) & (F.col("fills") > 1) & (F.col("values") > 0.5)).select("template")


_DEFAULT_FILL = r"^(undefined|null|None|NaN|nil)$"


def find_residue(df: DataFrame, doc_id: Column, text: Column, least_records: int = 3) -> DataFrame:
    """Texts with template residue or error-page text: doc_id, kinds (a sorted array); one row a text.

    Kinds: field (an unfilled field), default (unset values in place of values), filler, error,
    scripts (a demand for scripts, cookies or a check of the browser). Fields whose look alone does not
    tell are settled over the corpus: the name must stand in a slot of a template that at least
    `least_records` texts share and that is filled differently among them, or be written as an unmistakable
    field elsewhere in as many texts. Single unset values, names and gaps count where as many other texts fill their
    place with values (`record_slots`). Code, inline or fenced, and quoted text are left aside.
    Null, empty and blank texts are no cases; neither are rows without id. Repeated rows count once.
    """
    # What was spotted is a small part of the corpus and is read several times; the texts are read once, and once more where places are to be aligned.
    once = materialise(candidates(df, doc_id, text).distinct())
    gaps = once.where("kind = 'slot?'")
    held = gaps.limit(0).select("doc_id", F.col("name").alias("what"))
    if not gaps.isEmpty():
        slots_met = record_slots(gaps.select("template"), df, doc_id, text, least_records)
        held = materialise(lookup_join(gaps, slots_met, ["template"], "left_semi", salt_on=["doc_id"]).select("doc_id", F.col("name").alias("what")))
    fields = once.where("kind in ('field', 'field?') and name <> ''")
    # Slots of aligned records: one template, several texts, more than one filling.
    slots = fields.groupBy("template").agg(F.approx_count_distinct("doc_id").alias("texts"), F.min("name").alias("a"), F.max("name").alias("b")).where((F.col("texts") >= least_records) & (F.col("a") != F.col("b"))).select("template")
    in_slots = lookup_join(fields, slots, ["template"], "left_semi", salt_on=["doc_id"]).select("name")
    elsewhere = fields.where("kind = 'field'").groupBy("name").agg(F.approx_count_distinct("doc_id").alias("texts")).where(F.col("texts") >= least_records).select("name")
    aligned = held.where("what like 'field %'").select(F.substring_index("what", " ", -1).alias("name"))
    names = in_slots.unionByName(elsewhere).unionByName(aligned).distinct()
    settled = lookup_join(fields.where("kind = 'field?'"), names, ["name"], "left_semi", salt_on=["doc_id"]).select("doc_id", F.lit("field").alias("kind"))
    # Whole pages of one template: several with different texts, or several in all where the page says that it is one.
    pages = once.where("kind = 'page?'")
    numbered = pages.where("name <> ''").groupBy("template").agg(F.approx_count_distinct("name").alias("texts"))
    said = pages.where("name = ''").groupBy("template").agg(F.approx_count_distinct("doc_id").alias("texts"))
    repeated = numbered.unionByName(said).where(F.col("texts") >= least_records).select("template").distinct()
    whole = lookup_join(pages, repeated, ["template"], "left_semi", salt_on=["doc_id"]).select("doc_id", F.lit("error").alias("kind"))
    sure = once.where("kind not in ('field?', 'page?', 'slot?')").select("doc_id", "kind").unionByName(held.select("doc_id", F.substring_index("what", " ", 1).alias("kind")))
    return sure.unionByName(settled).unionByName(whole).groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def without_residue(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of `df` whose text is no case of `find_residue`, in all their columns."""
    cases = find_residue(df, F.col(doc_id), F.col(text)).select(F.col("doc_id").alias(doc_id))
    return lookup_join(df, cases, [doc_id], "left_anti", salt_on=[doc_id])
