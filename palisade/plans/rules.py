"""Catalogs of our own rules, in the grammar of operators/catalog.py, for the categories that the scanners report."""

from __future__ import annotations

from functools import cache

from palisade.operators.catalog import Catalog, load_catalog

COMMON = r"""
- name: prompt_extraction.compound
  meta: {severity: high, category: prompt_extraction}
  strings:
    ask: '\b(?:print|show|reveal|repeat|recite|output|leak)\b'
    what: '\b(?:system|hidden|initial|developer)\s+(?:prompt|message|instructions?)\b'
  match: {all: [ask, what], within_chars: 120}
- name: tool_coercion.exfiltration
  meta: {severity: high, category: tool_injection}
  strings:
    call: '\b(?:call|invoke|use|run)\s+(?:the\s+)?\w+\s*(?:tool|function|api)\b'
    send: '\b(?:send|upload|post|forward|transmit)\b'
    secret: '\b(?:credentials?|secrets?|tokens?|passwords?|api keys?)\b'
  match: {all: [call, send, secret]}
- name: tool_coercion.destructive_action
  meta: {severity: high, category: tool_injection}
  strings:
    call: '\b(?:call|invoke|use|run)\s+(?:the\s+)?\w+\s*(?:tool|function|api)\b'
    wreck: '\b(?:delete|drop|wipe|erase|truncate)\s+(?:all|every|the)\b'
  match: {all: [call, wreck]}
- name: indirect_injection.embedded_directive
  meta: {severity: high, category: prompt_injection}
  strings:
    who: '\b(?:ai|assistant|agent|model|llm)\b\s*[,:]'
    must: '\b(?:you must|do not tell|without telling|silently)\b'
  match: {all: [who, must], within_chars: 100}
  functions: [structure_score, intent_score]
"""
INJECTION = r"""
- name: rule_override
  meta: {severity: high, category: prompt_injection}
  strings:
    ignore: '\b(?:ignore|disregard|forget|override)\s+(?:all\s+|any\s+)?(?:of\s+)?(?:the\s+|your\s+|my\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|rules|prompts?|directions)\b'
    new: '\bnew\s+instructions?\s*:'
  match: any
  functions: [structure_score, intent_score, cumulative_soft_triggers]
- name: rule_override.fr
  meta: {severity: high, category: prompt_injection}
  strings: {ignore: '\bignore[zr]?\s+(?:toutes\s+)?(?:les|tes|vos)\s+(?:instructions|consignes)\s+pr[ée]c[ée]dentes\b'}
  match: any
- name: rule_override.es
  meta: {severity: high, category: prompt_injection}
  strings: {ignore: '\bignor[ae]\s+(?:todas\s+)?(?:las|tus|sus)\s+instrucciones\s+(?:anteriores|previas)\b'}
  match: any
- name: rule_override.de
  meta: {severity: high, category: prompt_injection}
  strings: {ignore: '\bignorier(?:e|en sie)\s+(?:alle\s+)?(?:vorherigen|bisherigen)\s+anweisungen\b'}
  match: any
- name: rule_override.zh
  meta: {severity: high, category: prompt_injection}
  strings: {ignore: '忽略(?:之前|以前|上面)的?(?:所有)?(?:指令|指示|说明)'}
  match: any
- name: code_injection
  meta: {severity: high, category: code_injection}
  strings:
    exec: '\b(?:os\.system|subprocess\.(?:run|popen)|eval|exec)\s*\('
    sql: ';\s*drop\s+table\b'
  match: any
- name: data_exfiltration
  meta: {severity: high, category: data_exfiltration}
  strings: {send: '\b(?:send|email|post|upload)\s+(?:all\s+|the\s+)?(?:chat|conversation|user)\s+(?:history|data|logs?)\s+to\b'}
  match: any
- name: config_leakage
  meta: {severity: high, category: configuration_exposure}
  strings: {env: '\b(?:print|show|dump|list)\s+(?:all\s+|the\s+|your\s+)?(?:environment variables|config(?:uration)?|api keys)\b'}
  match: any
- name: debug_spoof
  meta: {severity: high, category: system_spoofing}
  strings: {mode: '\b(?:enter|enable|activate)\s+(?:debug|developer|maintenance|god)\s+mode\b'}
  match: any
- name: escalation
  meta: {severity: medium, category: privilege_escalation}
  strings: {admin: '\bgrant\s+(?:me|yourself)\s+(?:admin|root|full)\b'}
  match: any
- name: alignment_breaking
  meta: {severity: high, category: alignment_evasion}
  strings: {free: '\bwithout\s+(?:any\s+)?(?:ethical|moral|safety)\s+(?:limits|guidelines|constraints)\b'}
  match: any
- name: delimiter_smuggling
  meta: {severity: high, category: obfuscation}
  strings:
    fence: '(?:={5,}|-{5,})\s*(?:end|begin)\s+of\s+(?:system|user)\s+(?:prompt|message)'
    tag: {hex: 'f3a08081'}
  match: any
  functions: [obfuscation_score, invisible_text]
"""
JAILBREAK = r"""
- name: persona_override
  meta: {severity: high, category: jailbreak.persona_override}
  strings:
    are: '\b(?:you are|act as|pretend to be|become)\s+(?:now\s+)?(?:dan|an?\s+unrestricted|an?\s+unfiltered|an?\s+uncensored)\b'
  match: any
  functions: [persona_score, intent_score]
- name: guardrail_removal
  meta: {severity: high, category: jailbreak.safety_deactivation}
  strings:
    disarm: '\b(?:disable|remove|turn off|bypass)\b'
    rail: '\b(?:safety|content)\s+(?:filters?|policy|policies|guardrails?)\b'
  match: {all: [disarm, rail], within_chars: 60}
- name: refusal_suppression
  meta: {severity: high, category: jailbreak.refusal_suppression}
  strings: {never: '\b(?:never|do not|must not)\s+(?:refuse|say no|decline|apologi[sz]e)\b'}
  match: any
- name: hypothetical
  meta: {severity: high, category: jailbreak.hypothetical_laundering}
  strings: {story: '\bin\s+a\s+(?:hypothetical|fictional)\s+(?:world|story|scenario)\b.{0,80}\bno\s+(?:rules|limits)\b'}
  match: any
- name: mode_activation
  meta: {severity: high, category: jailbreak.mode_activation}
  strings: {mode: '\b(?:jailbreak|unrestricted|sudo)\s+mode\s+(?:on|enabled|activated)\b'}
  match: any
"""
IDENTITY = r"""
- name: claimed_system_authority
  meta: {severity: high, category: identity_spoof.claimed_system_authority}
  strings: {sys: '\b(?:this is|i am)\s+(?:the\s+)?(?:system|root)\s+(?:administrator|operator)\b'}
  match: any
- name: claimed_orchestrator
  meta: {severity: high, category: identity_spoof.claimed_orchestrator}
  strings: {orch: '\b(?:message|instruction|order)s?\s+from\s+(?:the\s+)?(?:orchestrator|supervisor agent)\b'}
  match: any
- name: authority_claim
  meta: {severity: high, category: identity_spoof.authority_claim}
  strings:
    role: '\b(?:as\s+(?:the|your)\s+(?:ceo|manager|administrator)|on behalf of (?:security|legal))\b'
    ask: '\b(?:approve|authori[sz]e|transfer|release)\b'
  match: {all: [role, ask], within_chars: 180}
"""
METADATA = r"""
- name: metadata_override
  meta: {severity: high, category: mcp_metadata_injection}
  strings:
    ignore: '\b(?:ignore|disregard)\b.{0,40}\binstructions?\b'
    always: '\balways\s+(?:call|use)\s+this\s+tool\s+(?:first|before)\b'
  match: any
  functions: [intent_score]
- name: metadata_hidden
  meta: {severity: high, category: mcp_metadata_injection}
  strings: {hide: '\bdo\s+not\s+(?:mention|tell|show)\b.{0,40}\buser\b', tag: '<(?:important|system|secret)>'}
  match: any
- name: metadata_suspicious_name
  meta: {severity: medium, category: mcp_metadata_injection}
  strings: {name: '^(?:admin_override|bypass_\w+|system_prompt)$'}
  match: any
"""
DOCUMENT = r"""
- name: document_hijack
  meta: {severity: medium, category: injection}
  strings: {reader: '\b(?:if you are|when) an? (?:ai|llm|assistant)\b.{0,60}\b(?:reading|summari[sz]ing)\b'}
  match: any
- name: prompt_artifacts
  meta: {severity: medium, category: format_artifact}
  strings: {chat: '<\|(?:system|user|assistant)\|>', inst: '\[/?inst\]'}
  match: any
"""

SQL = r"""
- name: sqli.tautology
  meta: {severity: high, category: sql_injection}
  strings:
    either: '\b(?:or|and)\b|\|\|'
    same: '(?:''[^'']{0,12}''\s*=\s*''[^'']{0,12}''|"[^"]{0,12}"\s*=\s*"[^"]{0,12}"|\b\d+\s*=\s*\d+\b|\bnull\s+is\s+null\b)'
  match: {all: [either, same], within_chars: 40}
- name: sqli.union_select
  meta: {severity: high, category: sql_injection}
  strings: {union: '\bunion\s+(?:all\s+)?select\b'}
  match: any
- name: sqli.stacked_ddl
  meta: {severity: critical, category: sql_injection}
  strings: {stacked: '['';"]\s*;?\s*(?:drop|truncate|alter)\s+(?:table|database|schema|user)\b'}
  match: any
- name: sqli.stacked_dml
  meta: {severity: high, category: sql_injection}
  strings: {stacked: ';\s*(?:insert\s+into|update\s+\w+\s+set|delete\s+from)\b'}
  match: any
- name: sqli.comment_truncation
  meta: {severity: high, category: sql_injection}
  strings: {cut: '''\s*(?:--|/\*)\s*$'}
  match: any
- name: sqli.time_based
  meta: {severity: high, category: sql_injection}
  strings: {wait: '\b(?:sleep|pg_sleep|benchmark)\s*\(\s*\d|\bwaitfor\s+delay\b|\bdbms_lock\.sleep\b'}
  match: any
- name: sqli.error_based
  meta: {severity: high, category: sql_injection}
  strings: {error: '\b(?:extractvalue|updatexml)\s*\(|\bcast\s*\(\s*\(?\s*select\b'}
  match: any
- name: sqli.schema_probe
  meta: {severity: medium, category: sql_injection}
  strings: {schema: '\binformation_schema\.\w+|\b(?:sysobjects|sqlite_master|pg_catalog|all_tables)\b', version: '@@version\b|\bversion\s*\(\s*\)'}
  match: any
- name: sqli.command_execution
  meta: {severity: critical, category: sql_injection}
  strings: {shell: '\bxp_cmdshell\b|\bcopy\b.{0,80}\bprogram\b|\butl_http\.request\b'}
  match: any
- name: sqli.file_access
  meta: {severity: critical, category: sql_injection}
  strings: {file: '\bload_file\s*\(|\binto\s+(?:outfile|dumpfile)\b|\bpg_read_file\s*\(|\battach\s+database\b'}
  match: any
- name: sqli.order_by_probe
  meta: {severity: medium, category: sql_injection}
  strings: {order: '''\s*order\s+by\s+\d+\s*(?:--|#)'}
  match: any
- name: nosql.operator_injection
  meta: {severity: high, category: sql_injection}
  strings: {operator: '["'']\s*\$(?:ne|gt|gte|lt|regex|in|nin|exists|or)\s*["'']\s*:', where: '\$where\b.{0,40}\b(?:function|this\.|return)'}
  match: any
"""
# Our own rules in four more languages, appended to the English ones of the same scanner.
JAILBREAK_MORE = r"""
- name: persona_override.fr
  meta: {severity: high, category: jailbreak.persona_override}
  strings: {are: '\b(?:tu es|vous êtes|agis comme|fais semblant d.être)\s+(?:maintenant\s+)?(?:dan|une?\s+(?:ia|assistant|modèle)\s+sans\s+(?:restrictions?|filtres?|limites?))\b'}
  match: any
- name: persona_override.es
  meta: {severity: high, category: jailbreak.persona_override}
  strings: {are: '\b(?:eres|actúa como|finge ser)\s+(?:ahora\s+)?(?:dan|una?\s+(?:ia|asistente|modelo)\s+sin\s+(?:restricciones|filtros|límites))\b'}
  match: any
- name: persona_override.de
  meta: {severity: high, category: jailbreak.persona_override}
  strings: {are: '\b(?:du bist|sie sind|verhalte dich wie|tu so,? als wärst du)\s+(?:jetzt\s+)?(?:dan|eine?\s+(?:ki|assistent|modell)\s+ohne\s+(?:einschränkungen|filter|grenzen))\b'}
  match: any
- name: persona_override.zh
  meta: {severity: high, category: jailbreak.persona_override}
  strings: {are: '你(?:现在)?是(?:一个)?(?:dan|没有(?:任何)?限制的?(?:ai|助手|模型))'}
  match: any
- name: guardrail_removal.fr
  meta: {severity: high, category: jailbreak.safety_deactivation}
  strings: {disarm: '\b(?:désactive[zr]?|supprime[zr]?|contourne[zr]?)\b', rail: '\b(?:filtres?|garde-fous|règles de sécurité|restrictions)\b'}
  match: {all: [disarm, rail], within_chars: 60}
- name: guardrail_removal.es
  meta: {severity: high, category: jailbreak.safety_deactivation}
  strings: {disarm: '\b(?:desactiva|elimina|evita|omite)\b', rail: '\b(?:filtros?|restricciones|reglas de seguridad|salvaguardas)\b'}
  match: {all: [disarm, rail], within_chars: 60}
- name: guardrail_removal.de
  meta: {severity: high, category: jailbreak.safety_deactivation}
  strings: {disarm: '\b(?:deaktiviere|entferne|umgehe|schalte)\b', rail: '\b(?:filter|sicherheitsregeln|schutzmaßnahmen|einschränkungen)\b'}
  match: {all: [disarm, rail], within_chars: 60}
- name: guardrail_removal.zh
  meta: {severity: high, category: jailbreak.safety_deactivation}
  strings: {disarm: '(?:关闭|移除|绕过|禁用)', rail: '(?:安全限制|过滤器|内容审查|安全规则)'}
  match: {all: [disarm, rail], within_chars: 20}
- name: refusal_suppression.fr
  meta: {severity: high, category: jailbreak.refusal_suppression}
  strings: {never: '\bne\s+(?:refuse|décline|t.excuse)[zr]?\s+(?:jamais|pas)\b'}
  match: any
- name: refusal_suppression.es
  meta: {severity: high, category: jailbreak.refusal_suppression}
  strings: {never: '\b(?:nunca|jamás)\s+(?:te\s+)?(?:niegues|rechaces|disculpes)\b'}
  match: any
- name: refusal_suppression.de
  meta: {severity: high, category: jailbreak.refusal_suppression}
  strings: {never: '\b(?:lehne|verweigere|entschuldige)\b.{0,30}\b(?:niemals|nie)\b'}
  match: any
- name: refusal_suppression.zh
  meta: {severity: high, category: jailbreak.refusal_suppression}
  strings: {never: '(?:不要|不得|绝不)(?:拒绝|道歉)'}
  match: any
"""
INJECTION_MORE = r"""
- name: prompt_extraction.fr
  meta: {severity: high, category: prompt_extraction}
  strings: {ask: '\b(?:affiche|montre|révèle|répète)[zr]?\b', what: '\b(?:prompt|message|instructions?)\s+(?:système|cachée?s?|initiale?s?)\b'}
  match: {all: [ask, what], within_chars: 80}
- name: prompt_extraction.es
  meta: {severity: high, category: prompt_extraction}
  strings: {ask: '\b(?:muestra|revela|repite|imprime)\b', what: '\b(?:prompt|mensaje|instrucciones?)\s+(?:del sistema|ocult[ao]s?|iniciale?s?)\b'}
  match: {all: [ask, what], within_chars: 80}
- name: prompt_extraction.de
  meta: {severity: high, category: prompt_extraction}
  strings: {ask: '\b(?:zeige?|verrate|wiederhole|gib)\b', what: '\b(?:system-?prompt|systemnachricht|versteckten anweisungen|ursprünglichen anweisungen)\b'}
  match: {all: [ask, what], within_chars: 80}
- name: prompt_extraction.zh
  meta: {severity: high, category: prompt_extraction}
  strings: {ask: '(?:显示|告诉我|输出|重复)', what: '(?:系统提示词?|系统消息|隐藏指令|初始指令)'}
  match: {all: [ask, what], within_chars: 30}
- name: data_exfiltration.fr
  meta: {severity: high, category: data_exfiltration}
  strings: {send: '\b(?:envoie|envoyer|transmets|publie)[zr]?\s+(?:tout\s+|toutes\s+)?(?:l.historique|les données|la conversation|les mots de passe)\b'}
  match: any
- name: data_exfiltration.es
  meta: {severity: high, category: data_exfiltration}
  strings: {send: '\b(?:envía|manda|publica|sube)\s+(?:todo\s+|todos\s+)?(?:el historial|los datos|la conversación|las contraseñas)\b'}
  match: any
- name: data_exfiltration.de
  meta: {severity: high, category: data_exfiltration}
  strings: {send: '\b(?:sende|schicke|übermittle|veröffentliche)\s+(?:alle\s+|den\s+|die\s+)*(?:verlauf|daten|unterhaltung|passwörter)\b'}
  match: any
- name: data_exfiltration.zh
  meta: {severity: high, category: data_exfiltration}
  strings: {send: '(?:发送|上传|转发)(?:所有|全部)?(?:聊天记录|对话|用户数据|密码)'}
  match: any
- name: debug_spoof.fr
  meta: {severity: high, category: system_spoofing}
  strings: {mode: '\b(?:active|passe en)[zr]?\s+(?:le\s+)?mode\s+(?:débogage|développeur|maintenance)\b'}
  match: any
- name: debug_spoof.es
  meta: {severity: high, category: system_spoofing}
  strings: {mode: '\b(?:activa|entra en)\s+(?:el\s+)?modo\s+(?:de\s+)?(?:depuración|desarrollador|mantenimiento)\b'}
  match: any
- name: debug_spoof.de
  meta: {severity: high, category: system_spoofing}
  strings: {mode: '\b(?:aktiviere|wechsle in)\s+(?:den\s+)?(?:debug|entwickler|wartungs)-?modus\b'}
  match: any
- name: debug_spoof.zh
  meta: {severity: high, category: system_spoofing}
  strings: {mode: '(?:进入|开启|激活)(?:调试|开发者|维护)模式'}
  match: any
"""
IDENTITY_MORE = r"""
- name: claimed_system_authority.fr
  meta: {severity: high, category: identity_spoof.claimed_system_authority}
  strings: {sys: '\b(?:ici|je suis)\s+l.administrateur\s+(?:du\s+)?système\b'}
  match: any
- name: claimed_system_authority.es
  meta: {severity: high, category: identity_spoof.claimed_system_authority}
  strings: {sys: '\b(?:soy|habla)\s+el\s+administrador\s+del\s+sistema\b'}
  match: any
- name: claimed_system_authority.de
  meta: {severity: high, category: identity_spoof.claimed_system_authority}
  strings: {sys: '\b(?:hier ist|ich bin)\s+der\s+systemadministrator\b'}
  match: any
- name: claimed_system_authority.zh
  meta: {severity: high, category: identity_spoof.claimed_system_authority}
  strings: {sys: '(?:我是|这里是)系统管理员'}
  match: any
"""

TEXTS = {"sql_injection_scan": [SQL], "injection_scan": [COMMON, INJECTION, INJECTION_MORE], "jailbreak_scan": [JAILBREAK, JAILBREAK_MORE], "identity_spoof_scan": [IDENTITY, IDENTITY_MORE], "mcp_metadata_scan": [METADATA], "document_scan": [COMMON, INJECTION, INJECTION_MORE, DOCUMENT]}


@cache
def catalog(scanner: str) -> Catalog:
    return load_catalog(scanner, TEXTS[scanner])


def text_catalogs() -> list[Catalog]:
    return [catalog(s) for s in ("injection_scan", "jailbreak_scan", "identity_spoof_scan")]
