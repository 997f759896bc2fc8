"""The pattern rules that a scan runs unless others are named."""

from __future__ import annotations

from .patterns import PatternRule

# Ids, severities, what is matched, and the messages of the shipped pattern rules.
SHIPPED = [
    PatternRule("J001", "MethodCall", {"callee": ["System.out", "System.err"], "method": ["print", "println", "printf"]}, "不要使用 {callee}.{method}，请使用日志框架（SLF4J）", "minor", "禁止使用 System.out / System.err 直接打印"),
    PatternRule("J003", "Import", {"is_wildcard": "true"}, "禁止使用通配符 import，应明确导入具体类", "minor", "import 不使用通配符"),
    PatternRule("J004", "ClassDeclaration", {"name": "^[a-z]"}, "类名应使用 PascalCase（大写驼峰命名）", "minor", "类名使用 PascalCase"),
    PatternRule("J005", "MethodDeclaration", {"name": "^[A-Z]"}, "方法名应使用 camelCase（小写驼峰命名）", "minor", "方法名使用 camelCase"),
    PatternRule("J007", "FieldDeclaration", {"modifier": "final", "name": "[a-z]"}, "常量（static final 字段）应使用 UPPER_SNAKE_CASE 命名", "minor", "常量使用 UPPER_SNAKE_CASE"),
    PatternRule(
        "J010",
        "Import",
        {"package": "com.alibaba.fastjson*"},
        "禁止使用 fastjson / fastjson2（com.alibaba.fastjson*），存在反序列化安全漏洞（autotype RCE）风险，请改用 jackson（com.fasterxml.jackson）",
        "major",
        "禁止使用 fastjson / fastjson2，推荐使用 jackson",
    ),
    PatternRule(
        "J014",
        "Import",
        {"package": ["com.google.gson*", "org.json*", "net.sf.json*", "org.codehaus.jackson*"]},
        "禁止使用非 jackson（com.fasterxml.jackson）的 JSON 框架（{package}），请统一使用部门默认的 jackson；如必须使用请走部门审核确认（存量应改尽改）",
        "major",
        "禁止引入非 jackson（com.fasterxml.jackson）的 JSON 框架",
    ),
]
