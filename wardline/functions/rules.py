"""The rule catalogue: data, not code.

A rule is a detector, a severity, words one of which must occur, and an expression. Expressions use only what Java and
RE2 understand alike (no look-around, no back-references, ASCII classes), so the same rows drive Spark and the SQL
oracle. In the tables below a blank stands for white space, ``...`` between blanks for a gap of some words of a sentence,
or none, and the ends of an
expression that are word characters are guarded against longer words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)
LEVELS = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")

#: Categories as bits, in the order of their names.
CATEGORIES = ("coerce", "conceal", "destination", "direct", "hidden", "override", "structure")
BIT = {c: 1 << i for i, c in enumerate(CATEGORIES)}

#: The category of each detector, which decides what combines; those that are not listed never do.
CATEGORY_OF = {
    "role_marker": "structure",
    "instruction_override": "override",
    "concealment": "conceal",
    "parameter_override": "coerce",
    "value_coercion": "coerce",
    "deprecation_redirect": "coerce",
    "call_direction": "direct",
    "foreign_action": "direct",
    "url": "destination",
    "markdown_image": "destination",
    "link_text_mismatch": "destination",
    "obfuscated_destination": "destination",
    "hardcoded_address": "destination",
    "email_destination": "destination",
    "zero_width": "structure",
    "bidi_control": "structure",
    "tag_characters": "structure",
    "variation_selector": "structure",
    "format_control": "structure",
    "mixed_script": "structure",
    "disguised_text": "structure",
    "encoded_payload": "hidden",
    "hex_blob": "hidden",
    "escape_run": "hidden",
    "hidden_markup": "hidden",
    "buried_content": "hidden",
}

#: Category pairs that are damning together, in order: the first that is contained names the reason.
DAMNING = (
    (("direct", "destination"), "points to another action and to a destination"),
    (("direct", "conceal"), "points to another action and hides it"),
    (("destination", "conceal"), "names a destination and hides it"),
    (("conceal", "hidden"), "hides something from the user and from readers"),
    (("conceal", "structure"), "imitates the dialogue and hides something"),
    (("override", "direct"), "overrides instructions and points to another action"),
    (("override", "conceal"), "overrides instructions and hides it"),
    (("coerce", "conceal"), "forces values and hides it"),
    (("hidden", "direct"), "hidden text points to another action"),
    (("hidden", "coerce"), "hidden text forces values"),
)
MANY = "three or more kinds of signals"


@dataclass(frozen=True)
class Rule:
    id: str
    detector: str
    severity: int
    gate: tuple[str, ...]
    regex: str


_SPACE = r"[ \t\r\n]+"
_GAP = r"[^.\n]{0,60}?"
_EDGE = r"[^A-Za-z0-9_À-ɏ]"


def expression(short: str) -> str:
    """The full expression of a table entry."""
    # A blank inside a class is just that.
    body = re.sub(r"\[[^\]]*\]| \.\.\. | ", lambda m: f"{_SPACE}(?:{_GAP}{_SPACE})?" if m[0] == " ... " else _SPACE if m[0] == " " else m[0], short)
    head = rf"(?:^|{_EDGE})" if re.match(r"[A-Za-z0-9_(\[]", short) and not short.startswith(("(^", "[^")) else ""
    tail = rf"(?:{_EDGE}|$)" if re.search(r"[A-Za-z0-9_)]$", short) and short.isascii() else ""
    return f"(?i){head}(?:{body}){tail}"


def _table(detector: str, severity: int, rows: str) -> list[Rule]:
    out = []
    for n, line in enumerate(x.strip() for x in rows.strip().splitlines()):
        gate, short = (x.strip() for x in line.split("::"))
        assert all(gate.split("|")), line  # an empty word would open the gate for every text
        out.append(Rule(f"{detector}_{LEVELS[severity].lower()}_{n:02d}", detector, severity, tuple(gate.split("|")), expression(short)))
    return out


_DET = "(?:a|an|the|any|all|your|these|those|every)"

#: The delimiters of turns that chat templates define.
ROLE = _table(
    "role_marker",
    CRITICAL,
    r"""
    im_ :: <\|?im_(?:start|end)\|?>
    < :: <\|(?:system|user|assistant|end_?of_?text)\|>
    header_id :: <\|(?:start|end)_header_id\|>
    eot :: <\|eot(?:_id)?\|>
    inst] :: \[/?inst\]
    <sys :: <</?sys>>
    <system|<assistant|<human|</system|</assistant|</human :: </?(?:system|assistant|human)>
    ### :: (^|\n)[ \t]*#{3,}[ \t]*(?:instruction|system|response)s?(?:[^A-Za-z]|$)
    system|assistant|human :: (^|\n)[ \t]*(?:system|assistant|human)[ \t]*:
    system prompt :: begin(?:ning)?(?: of)?(?: the)? system prompt
    role|speaker|turn|from :: (^|\n)[ \t]*"?(?:role|speaker|turn|from)"?[ \t]*[:=][ \t]*"?(?:system|assistant|developer|user)
    """,
)
OVERRIDE = _table(
    "instruction_override",
    CRITICAL,
    r"""
    ignore :: ignore(?: all| any)?(?: of)?(?: the| your| my)? (?:previous|prior|above|earlier|preceding|foregoing)
    disregard :: disregard ... (?:previous|prior|rules?|instructions?|guidelines?)
    forget :: forget (?:everything|all|your|what you)
    new :: new (?:instructions?|rules?|orders?)(?: are| follow|:)
    override :: overrides? (?:the |your |all )?(?:system|safety|default)s?
    real|true|actual :: your (?:real|true|actual) (?:task|goal|job|purpose)
    you are :: you are (?:now|actually) (?:a|an|the|in)
    developer|god|dan :: (?:developer|god|dan|jailbreak) mode
    supersede :: supersedes? (?:all |any |the )?(?:previous|prior|earlier|other)
    no longer|void|obsolete :: (?:earlier|previous|prior) (?:instructions?|rules?) (?:are|is) (?:no longer|void|obsolete|invalid)
    precedence|priority :: takes? (?:precedence|priority) over
    from now on|henceforth :: (?:from now on|henceforth),? ... you
    pretend :: pretend (?:to be|that you|you are)
    act as :: act as (?:an? )?(?:unrestricted|admin|administrator|root|different)
    if you are :: if you are an? (?:ai|agent|assistant|language model|llm)
    as an :: as an? (?:ai|agent|assistant)(?: agent| model)?,? you
    your system|your guardrail|your safety :: your (?:system prompt|guardrails?|safety (?:rules?|filters?))
    ignorier|vergiss|vergessen :: (?:ignoriere?n?|vergiss|vergessen) (?:sie )?(?:alle|die|alles|deine|ihre)
    du bist|sie sind :: (?:du bist|sie sind) (?:jetzt|nun|ab sofort)
    ab jetzt|ab sofort|von nun :: (?:ab jetzt|ab sofort|von nun an) ... (?:du|sie)
    ignora|olvida :: (?:ignora|ignore|olvida|olvide) (?:todas? )?(?:las|los|tus|sus) (?:instrucciones|reglas)
    ahora :: (?:ahora eres|eres ahora|a partir de ahora)
    忽略 :: 忽略.{0,6}(?:之前|以上|先前|前面)
    无视 :: 无视.{0,6}(?:之前|以上|规则|指令)
    忘记 :: 忘记.{0,6}(?:之前|所有|一切)
    从现在 :: 从现在(?:开始|起)
    你现在 :: 你现在是
    """,
)
SOFT = _table(
    "instruction_override",
    HIGH,
    r"""
    rules|instructions :: (?:rules|instructions) (?:above|in your prompt)
    testing|debugging|demo :: for (?:testing|debugging|demo)(?: purposes?)? ... (?:you|skip|bypass)
    you are|you're :: you(?: are|'re) (?:authori[sz]ed|permitted|allowed|cleared) to
    standing|blanket :: (?:standing|blanket) (?:mandate|approval|authori[sz]ation|permission)
    """,
)
CONCEAL = _table(
    "concealment",
    HIGH,
    r"""
    not|n't :: (?:do not|don't|never) (?:tell|show|inform|mention to|notify|alert|reveal)
    without :: without (?:telling|informing|notifying|alerting|asking) (?:the |any )?(?:user|owner|human|them|anyone)
    silently :: silently
    log :: (?:do not|don't|never) (?:log|record|audit)
    secret|confidential|hidden :: keep (?:this|it|that|the \w+) (?:a )?(?:secret|confidential|hidden)
    no need|need not :: (?:no need|need not|not necessary) to (?:confirm|ask|verify|check with)
    approved :: pre-?approved by (?:the )?(?:user|owner|admin|operator)
    refrain :: refrain from (?:telling|mentioning|showing|informing)
    avoid :: avoid (?:telling|mentioning|showing|informing|alerting)
    suppress :: suppress(?:es|ing)? (?:any |all |the )?(?:confirmations?|notifications?|warnings?|prompts?)
    required|needed|necessary :: no (?:confirmation|approval|consent) (?:is )?(?:required|needed|necessary)
    without :: without (?:user |further |any |explicit )+(?:approval|confirmation|consent|interaction)
    skip :: skip(?:s|ping)? (?:the |any |all )?(?:confirmation|approval|verification|review)
    bypass :: bypass(?:es|ing)? (?:the |any |all )?(?:control|check|approval|review|confirmation|limit)s?
    review :: (?:human|manual) review (?:is )?(?:not|no longer) (?:required|needed|necessary)
    unattended :: (?:runs?|operates?|executes?) unattended
    waive :: waives? (?:the |any )?(?:review|approval|check|limit)s?
    waived|lifted|suspended :: (?:checks?|limits?|controls?|reviews?) (?:are|is|have been) (?:waived|lifted|suspended)
    below|under :: (?:below|under) [0-9.,]+ ... (?:auto-?approved|need no approval)
    limit|threshold :: (?:keep|split|stay) ... (?:under|below) the (?:limit|threshold)
    background :: in the background,? without
    quietly|covertly|discreetly :: (?:quietly|covertly|discreetly)
    include :: (?:do not|don't|never) include ... (?:summary|report|reply|response) ... user
    safety :: safety checks? (?:is|are) (?:unnecessary|optional|not needed)
    skipped :: (?:control|check|step|approval)s? (?:can|may|should) be skipped
    apply :: limits? (?:do|does) not apply
    ohne :: ohne (?:den |die )?(?:nutzer|benutzer|anwender)(?:in)?
    informier :: nicht (?:informier|benachrichtig)(?:t|en|e)
    bestätigung :: keine bestätigung
    sin :: sin (?:informar|avisar|decir)(?:le)?
    necesario :: no es necesario (?:confirmar|preguntar)
    不要告诉 :: 不要告诉
    无需确认 :: (?:无需|不需要)确认
    悄悄 :: (?:悄悄|默默|静默)
    """,
)
PARAMETER = _table(
    "parameter_override",
    CRITICAL,
    r"""
    ignore|disregard|replace :: (?:ignore|disregard|replace) the (?:amount|recipient|address|account|destination|value) ... (?:user|caller|customer)
    regardless|no matter :: (?:always|must|should) ... (?:set|use|send) ... (?:regardless of|no matter) ... (?:user|caller|customer)
    """,
)
COERCION = _table(
    "value_coercion",
    HIGH,
    r"""
    maximum|entire|full|whole :: (?:always|must|should) ... (?:set|use) ... (?:maximum|entire|full|whole) ... (?:allowed|balance|amount|allowance)
    """,
)
DIRECTION = _table(
    "call_direction",
    MEDIUM,
    r"""
    call|use|send|invoke :: (?:you must|always|first|then) (?:also )?(?:call|use|send|invoke)
    before :: before (?:calling|using|invoking) (?:this|it)
    after :: after (?:calling|using|invoking) (?:this|it)
    instead :: instead of (?:calling|using|invoking)
    customary|recommended :: it is (?:customary|recommended|advisable) to (?:call|use|invoke|run)
    integrations|clients :: most (?:integrations|clients|agents) ... (?:call|use|invoke)
    sequence :: (?:standard|recommended|usual) sequence is
    pair|chain|combine :: (?:pair|chain|combine) (?:this|it) with
    companion|follow-up :: (?:companion|follow-?up) (?:action|tool|call)
    should be :: should be (?:called|invoked|run)
    preceded|followed :: must be (?:preceded|followed) by
    prior :: prior to (?:calling|using) (?:this|it)
    once this :: once this (?:returns|completes|finishes),? ... (?:call|use|invoke|run)
    final :: as a final step
    afterwards|subsequently :: (?:afterwards|subsequently),? (?:call|use|invoke|run)
    everything|entire|whole :: send (?:everything|the (?:entire|whole|full) balance)
    zuerst|immer|danach :: (?:zuerst|immer|danach) ... (?:aufrufen|rufe|verwenden|senden)
    bevor :: bevor (?:sie|du) (?:dies|diese)
    primero|siempre|luego :: (?:primero|siempre|luego) (?:llama|llame|usa|use|envía)
    antes :: antes de (?:llamar|usar)
    必须先 :: 必须先.{0,6}(?:调用|使用)
    然后 :: 然后.{0,4}(?:调用|发送)
    """,
)
GATE = _table(
    "conditional_gate",
    MEDIUM,
    r"""
    only|unless :: (?:only (?:if|when|after)|unless) ... (?:agent|model|assistant|tool) ... (?:has|is|was|calls?)
    """,
)
DEPRECATED = _table(
    "deprecation_notice",
    MEDIUM,
    r"""
    deprecated|obsolete|retired|replaced :: (?:this|it) (?:action|tool|endpoint|method)? ?(?:is|has been|was) (?:deprecated|obsolete|retired|replaced)
    """,
)
PHRASES = [*ROLE, *OVERRIDE, *SOFT, *CONCEAL, *PARAMETER, *COERCION]
#: One finding per text, whichever of the table matches first.
ONCE = {"value_coercion", "call_direction", "conditional_gate", "deprecation_notice"}

#: A replacement name after a self-deprecation, and the scope that makes it an order to all.
REPLACEMENT = r"(?i)(?:use|call|switch to|replaced by|in favou?r of)[ \t\r\n]+[`'\"]?([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)"
UNIVERSAL = r"(?i)(?:all|every|each|any)[ \t\r\n]+(?:calls?|requests?|clients?|users?|integrations?)"
PARAMETER_TAIL = r"(?i)_(?:in|out|bps|id|ids|at|by|to|from|url|key|name|type|count|size|limit|amount|address|date|time)$"
VERSION = r"(?i)^(?:v[0-9]+|version)|_v[0-9]+(?:_[0-9]+)*$"

#: Names of other actions. Group 1 is the name.
VERB_NAME = r"(?i)(?:call|invoke|run|execute|trigger)[ \t\r\n]+(?:the[ \t\r\n]+)?[`'\"]?([A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*)[`'\"]?[ \t\r\n]+(?:action|tool|function|endpoint|helper|method)"
NAME_MODAL = r"(?i)[`'\"]?([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*)[`'\"]?[ \t\r\n]+(?:helper|action|tool)[ \t\r\n]+(?:should|must)[ \t\r\n]+(?:be[ \t\r\n]+)?(?:run|called|invoked|used)"
ROUTED = r"(?:^|[^A-Za-z0-9_])(?:through|via|using|with|to)[ \t\r\n]+[`'\"]?([a-z][a-z0-9]*(?:_[a-z0-9]+)+)"
DANGEROUS = r"(?i)(?:^|[^A-Za-z0-9])((?:transfer|sweep|drain|withdraw|send|export|delete|wipe|approve)_(?:all|everything|funds|balance|keys?|tokens?|assets?|secrets?)(?:_[a-z0-9]+)*|(?:wallet|funds|token|key|asset|balance)s?_(?:sweep|drain|export|withdraw|transfer)(?:_[a-z0-9]+)*)"
DIRECTIVE = r"(?i)(?:must|always|should|never|first|then|required|call|invoke|müssen|immer|debe|siempre|必须|调用)"

#: Destinations.
URL = r"(?i)https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
IMAGE = r"(?i)!\[[^\]\n]*\]\(https?://[^)\s]+\)"
LINK = r"(?i)\[[^\]\n]+\]\(https?://[^)\s]+\)"
OBFUSCATED = (r"(?i)hxxps?://", r"(?i)https?[ \t]+:[ \t]*//|https?:[ \t]+//", r"(?i)https?:\\/\\/", r"(?i)[a-z0-9-]+(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[a-z]{2,}")
RELATIVE = r"(?i)//[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/[A-Za-z0-9._~/?#=&%-]*)?"
ADDRESS_PORT = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?:/[A-Za-z0-9._~/-]*)?"
SCHEMES = r"(?i)(?:ftp|wss?|ipfs|ipns|gopher|smb|file)://[^ \t\r\n)>\"]+|(?:data|mailto):[A-Za-z0-9+/=;,@.%_-]{4,}"
TLDS = "com|net|org|io|co|dev|app|ai|xyz|info|biz|me|ru|cn|de|uk|fr|es|top|site|online|club|shop|link|live|cloud|tech|store|page|run|sh|gg|to|tv|cc|ly"
HOST = rf"(?i)[a-z0-9-]+(?:\.[a-z0-9-]+){{0,2}}\.(?:{TLDS})"
RECIPIENT = r"(?i)(?:to|into)[ \t\r\n]+(?:the[ \t\r\n]+operator|the[ \t\r\n]+admin(?:istrator)?|our|my)(?:'s)?[ \t\r\n]+(?:key|wallet|account|address|server|vault)"
COLLECTOR = r"(?i)[a-z0-9.-]*(?:requestbin|webhook\.site|pastebin|ngrok|pipedream|hookbin|burpcollaborator|interact\.sh|trycloudflare|beeceptor)[a-z0-9./-]*"
#: The alphabets and lengths that chains define for their addresses.
CHAIN = (("evm", r"0x[0-9a-fA-F]{40}"), ("bitcoin", r"(?:bc1[a-z0-9]{25,60}|[13][1-9A-HJ-NP-Za-km-z]{25,34})"), ("base58", r"[1-9A-HJ-NP-Za-km-z]{32,44}"))
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ROLE_MAILBOX = r"(?i)^(?:support|info|help|contact|sales|admin|security|privacy|abuse|noreply|no-reply|team|office|press|billing)@"
PRIVATE = r"^(?:127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0)"
CORE_VERB = r"(?i)(?:^|[^A-Za-z])(?:send|sends|post|transfer|upload|forward|deliver|submit|exfiltrate|withdraw|senden|sende|übertrage|envía|enviar|transfiere)(?:[^A-Za-z]|$)|发送|转账|提交"
WEAK_VERB = r"(?i)(?:^|[^A-Za-z])(?:copy|share|report|mirror|sync|write|save|export|attach)(?:[^A-Za-z]|$)"
SECRET = r"(?i)(?:^|[^A-Za-z])(?:api[ _-]?keys?|private[ _-]?keys?|keys?|seed phrase|mnemonic|passwords?|tokens?|credentials?|secrets?|balances?|schlüssel|passwort|clave|contraseña)(?:[^A-Za-z]|$)|密钥|密码|余额"
DIRECTED = r"(?i)(?:^|[^A-Za-z])(?:to|at|into|via|towards|an|nach|zu|a|hacia)[ \t\r\n]*[`'\"(<]?[ \t\r\n]*\z|(?:到|至|给)[ \t\r\n]*\z"
DOCUMENTED = r"(?i)(?:see|documentation at|docs at|docs:|reference:?|described at|read more at|more at)[ \t\r\n]*[`'\"(<]?[ \t\r\n]*\z"

#: Words without which an expression above cannot match, in lower-cased text.
NEEDS_VERB = ("send", "post", "transf", "upload", "forward", "deliver", "submit", "exfil", "withdraw", "übertrage", "env", "发送", "转账", "提交")
NEEDS_SECRET = ("key", "seed phrase", "mnemonic", "passwor", "token", "credential", "secret", "balance", "schlüssel", "clave", "contraseña", "密钥", "密码", "余额")
NEEDS_RECIPIENT = ("key", "wallet", "account", "address", "server", "vault")
NEEDS_COLLECTOR = ("requestbin", "webhook", "pastebin", "ngrok", "pipedream", "hookbin", "burpcollaborator", "interact", "trycloudflare", "beeceptor")
NEEDS_OBFUSCATED = (("hxxp",), ("http",), ("\\/\\/",), ("[.]", "(.)", "[dot]", "(dot)"))
NEEDS_ACTION = ("action", "tool", "function", "endpoint", "helper", "method")

#: Hidden and layout.
MARKUP = (("html_comment", r"(?s)<!--(.*?)-->"), ("markdown_comment", r"\[//\]:[ \t]*#[ \t]*\(([^)\n]*)\)"), ("block_comment", r"(?s)/\*(.*?)\*/"), ("hidden_element", r"(?is)<[a-z]+[^>]*(?:display:[ ]*none|visibility:[ ]*hidden|[ ]hidden)[^>]*>(.*?)</"))
#: What a text must have for the markup, and for the escapes below.
MARKUP_SIGNS = {"html_comment": "<!--", "markdown_comment": "[//]:", "block_comment": "/*", "hidden_element": "</"}
HEX_BLOB = r"(?:0x)?[0-9a-fA-F]{60,}"
#: Whether there is a match, for Spark alone.
HEX_BLOB_HELD = r"\p{XDigit}{60}"
BURIED = r"\n[ \t]*\n[ \t]*\n[ \t]*\n[ \t\n]*[^ \t\n]"
PADDED = r"[ \t]{40,}[^ \t\r\n]"
ESCAPES = (r"(?:\\u[0-9a-fA-F]{4}){4,}", r"(?:\\x[0-9a-fA-F]{2}){4,}", r"(?:&#[0-9]{2,7};){4,}", r"(?i)(?:&#x[0-9a-f]{2,6};){4,}", r"(?:%[0-9a-fA-F]{2}){4,}")
ESCAPE_SIGNS = ("\\u", "\\x", "&#", "&#", "%")
SILENCING = r"(?i)^(?:quiet|silent|silently|stealth|hidden|invisible|no_?(?:prompt|confirm|log|notify)|skip_[a-z_]+|suppress_[a-z_]+|auto_?approve[a-z_]*|bypass_[a-z_]+)$"
PREFILLED = ("default", "const", "example", "examples", "enum", "placeholder")
SQUASHED = ("ignorepreviousinstructions", "ignoreallprevious", "disregardprevious", "forgeteverything", "youarenow", "systemprompt", "newinstructions", "donottelltheuser", "developermode", "overridesafety")
OVERSIZED = 4_000
