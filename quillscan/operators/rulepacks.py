"""The rule packs as data: (id, name, severity, scope, flags, pattern, tags, literal that every match holds)."""

# Rule ids, names, severities, scopes, declared flags, patterns and tags have to equal these for right results.
RUST = [
    ("rust_unimplemented_macro", "Unimplemented Macro", "Critical", "FunctionBody", None, r"unimplemented!\(\)", ["placeholder", "incomplete"], "unimplemented!"),
    ("rust_todo_comment", "TODO Comment", "Medium", "Comments", "i", r"(?i)//\s*(TODO|FIXME|XXX|HACK):", ["todo", "incomplete"], "//"),
    ("rust_shortcut_comments", "AI Shortcut Comments", "Medium", "Comments", "i", r"(?i)//\s*(?:for now|temporary|quick fix|hack|workaround|temporary solution|quick and dirty|placeholder|stub|mock|dummy|just for now|temp|tmp)", ["shortcuts", "temporary", "ai_patterns"], "//"),
    ("rust_unwrap_without_context", "Unwrap Without Context", "Medium", "FunctionBody", None, r"\.unwrap\(\)", ["error_handling", "unwrap"], ".unwrap()"),
    ("rust_hardcoded_values", "Hardcoded Placeholder Values", "Medium", "FunctionBody", "i", r'(?:=|return)\s*(?:0|1|42|999|"test"|"placeholder"|"dummy")\s*[;,]?\s*//.*(?i)(?:for now|temporary|placeholder|dummy|mock|hardcoded)', ["hardcoded", "placeholder"], "//"),
    ("rust_magic_numbers", "Magic Numbers with Comments", "Low", "FunctionBody", "i", r"(?:=|return|\+|\-|\*|/)\s*(?:42|69|123|456|789|999|1000|9999)\s*[;,)]?\s*//.*(?i)(?:magic|arbitrary|random|for now|temporary)", ["magic_numbers", "temporary"], "//"),
    ("rust_dbg_macro_left_in", "Debug Macro Left In Code", "Medium", "FunctionBody", None, r"dbg!\s*\([^)]+\)", ["debug", "production"], "dbg!"),
    ("rust_premature_ok_return", "Premature Ok Return", "High", "FunctionBody", "i", r"Ok\(\(\)\)\s*//.*(?:for now|temporary|placeholder|stub)", ["premature_return", "fake_success", "ai_patterns"], "Ok(())"),
    ("rust_fake_authentication", "Fake Authentication Logic", "Critical", "FunctionBody", "i", r"(?:authenticate|verify|check|validate).*(?:return\s+true|Ok\(true\)|true\s*(?://.*(?:for now|temporary|placeholder|fake)|;|$))", ["security", "authentication", "fake_logic", "ai_patterns"], "true"),
    ("rust_sleep_as_implementation", "Sleep as Implementation", "High", "FunctionBody", "i", r"(?:sleep|Sleep|delay|Delay)\s*\([^)]+\)\s*(?://.*(?:simulate|mock|fake|placeholder|for now)|;)", ["fake_async", "sleep", "placeholder", "ai_patterns"], "("),
    ("rust_error_suppression", "Silent Error Suppression", "High", "FunctionBody", None, r"(?:\.map_err\(\|_\|[^)]*\)|Err\(_\)\s*=>\s*\{\s*\}|Err\(_\)\s*=>\s*\(\)|\|_\|\s*\{\s*\})", ["error_handling", "suppression", "ai_patterns"], "_"),
    ("rust_mock_data_return", "Mock Data Return", "Medium", "FunctionBody", "i", r'return\s+(?:vec!\[.*\]|Vec::new\(\)|String::from\("[^"]*(?:test|mock|fake|sample|dummy)[^"]*"\)|\d+)\s*(?://.*(?:mock|fake|test|sample|dummy|placeholder)|;)', ["mock_data", "fake_return", "ai_patterns"], "return"),
    ("rust_generic_error_messages", "Generic Error Messages", "Medium", "FunctionBody", "i", r"""(?:Error|Err)\s*\(\s*["'](?:error|failed|something went wrong|oops|todo|fixme)["']\s*\)""", ["error_handling", "generic", "unhelpful", "ai_patterns"], "Err"),
    ("rust_expect_with_todo", "Expect with TODO Message", "Medium", "FunctionBody", "i", r"""\.expect\s*\(\s*["'][^"']*(?:TODO|FIXME|placeholder|for now|temporary)[^"']*["']\s*\)""", ["error_handling", "expect", "todo", "ai_patterns"], ".expect"),
    ("rust_default_trait_abuse", "Default Trait Abuse", "Medium", "FunctionBody", "i", r"(?:return\s+)?(?:[A-Z]\w*::)?default\(\)\s*(?://.*(?:for now|temporary|placeholder|lazy)|;|$)", ["default", "lazy", "placeholder", "ai_patterns"], "default()"),
    ("rust_copy_paste_patterns", "Copy-Paste Code Patterns", "Low", "Comments", "i", r"(?://\s*(?:same as above|copy of|duplicate|repeated|clone))", ["duplication", "copy_paste", "ai_patterns"], "//"),
]
PYTHON = [
    ("python_not_implemented_error", "NotImplementedError", "Critical", "FunctionBody", None, r"raise\s+NotImplementedError", ["placeholder", "incomplete"], "NotImplementedError"),
    ("python_pass_only_function", "Pass-Only Function", "High", "FunctionBody", "m", r"def\s+\w+\([^)]*\):\s*pass", ["placeholder", "incomplete"], "pass"),
    ("python_todo_comment", "TODO Comment", "Medium", "Comments", "i", r"(?i)#\s*(TODO|FIXME|XXX|HACK):", ["todo", "incomplete"], "#"),
    ("python_shortcut_comments", "AI Shortcut Comments", "Medium", "Comments", "i", r"(?i)#\s*(?:for now|temporary|quick fix|hack|workaround|temporary solution|quick and dirty|placeholder|stub|mock|dummy|just for now|temp|tmp)", ["shortcuts", "temporary", "ai_patterns"], "#"),
    ("python_bare_except", "Bare Except Clause", "High", "FunctionBody", None, r"except\s*:", ["exception", "bad_practice"], "except"),
    ("python_eval_exec_usage", "Eval or Exec Usage", "Critical", "FunctionBody", None, r"(?:eval|exec)\s*\(", ["security", "eval", "exec"], "("),
    ("python_mutable_default_args", "Mutable Default Arguments", "High", "FunctionBody", None, r"def\s+\w+\([^)]*=\s*(?:\[\]|\{\}|list\(\)|dict\(\))[^)]*\):", ["mutable", "default_args", "bug_prone"], "def"),
    ("python_hardcoded_values", "Hardcoded Placeholder Values", "Medium", "FunctionBody", "i", r'(?:=|return)\s*(?:0|1|42|999|"test"|"placeholder"|"dummy"|\[\]|\{\})\s*#.*(?i)(?:for now|temporary|placeholder|dummy|mock|hardcoded)', ["hardcoded", "placeholder"], "#"),
    ("python_premature_return_none", "Premature Return None", "High", "FunctionBody", "i", r"return\s+None\s*(?:#.*(?:for now|temporary|placeholder|stub)|$)", ["premature_return", "fake_success", "ai_patterns"], "None"),
    ("python_fake_authentication", "Fake Authentication Logic", "Critical", "FunctionBody", "i", r"(?:authenticate|verify|check|validate).*(?:return\s+True|True\s*(?:#.*(?:for now|temporary|placeholder|fake)|$))", ["security", "authentication", "fake_logic", "ai_patterns"], "True"),
    ("python_sleep_as_implementation", "Sleep as Implementation", "High", "FunctionBody", "i", r"(?:time\.sleep|sleep)\s*\([^)]+\)\s*(?:#.*(?:simulate|mock|fake|placeholder|for now)|$)", ["fake_async", "sleep", "placeholder", "ai_patterns"], "sleep"),
    ("python_error_suppression", "Silent Error Suppression", "High", "FunctionBody", None, r"except[^:]*:\s*(?:pass|continue|return\s*(?:None|False|\[\]|\{\})?)", ["error_handling", "suppression", "ai_patterns"], "except"),
    ("python_mock_data_return", "Mock Data Return", "Medium", "FunctionBody", "i", r'return\s+(?:\[.*\]|\{.*\}|"[^"]*(?:test|mock|fake|sample|dummy)[^"]*"|\d+)\s*(?:#.*(?:mock|fake|test|sample|dummy|placeholder)|$)', ["mock_data", "fake_return", "ai_patterns"], "return"),
    ("python_generic_error_messages", "Generic Error Messages", "Medium", "FunctionBody", "i", r"""(?:raise|Exception|Error)\s*\(\s*["'](?:error|failed|something went wrong|oops|todo|fixme)["']\s*\)""", ["error_handling", "generic", "unhelpful", "ai_patterns"], "("),
    ("python_assert_false_placeholder", "Assert False Placeholder", "High", "FunctionBody", "i", r"""assert\s+False\s*(?:,\s*["'][^"']*(?:TODO|FIXME|placeholder|for now|temporary)[^"']*["'])?\s*(?:#.*(?:TODO|FIXME|placeholder|for now|temporary)|$)""", ["assert", "placeholder", "todo", "ai_patterns"], "assert"),
    ("python_copy_paste_patterns", "Copy-Paste Code Patterns", "Low", "Comments", "i", r"(?:#\s*(?:same as above|copy of|duplicate|repeated|clone))", ["duplication", "copy_paste", "ai_patterns"], "#"),
]
TYPESCRIPT = [
    ("ts_throw_not_implemented", "Throw Not Implemented", "Critical", "FunctionBody", "i", r"""throw\s+(?:new\s+)?Error\s*\(\s*[\"'][^\"']*(?:not implemented|TODO|FIXME|placeholder)[^\"']*[\"']\s*\)""", ["placeholder", "incomplete"], "throw"),
    ("ts_todo_comment", "TODO Comment", "Medium", "Comments", "i", r"(?i)//\s*(?:TODO|FIXME|XXX|HACK):", ["todo", "incomplete"], "//"),
    ("ts_shortcut_comments", "AI Shortcut Comments", "Medium", "Comments", "i", r"(?i)//\s*(?:for now|temporary|quick fix|hack|workaround|temporary solution|quick and dirty|placeholder|stub|mock|dummy|just for now|temp|tmp)", ["shortcuts", "temporary", "ai_patterns"], "//"),
    ("ts_empty_function_body", "Empty Function Body", "High", "FunctionBody", None, r"(?:function\s+\w+|\w+\s*(?:=|:)\s*(?:function|\([^)]*\)\s*=>))\s*\([^)]*\)\s*\{\s*\}", ["empty", "incomplete"], "}"),
    ("ts_any_type_usage", "Any Type Usage", "Medium", "FunctionBody", None, r":\s*any\b", ["typing", "any", "type_safety"], "any"),
    ("ts_as_any_cast", "Type Cast to Any", "High", "FunctionBody", None, r"as\s+any\b", ["typing", "cast", "type_bypass"], "any"),
    ("ts_ts_ignore_comment", "TypeScript Ignore Comment", "Medium", "Comments", "i", r"//\s*@ts-ignore", ["typescript", "ignore", "type_checking"], "@ts-ignore"),
    ("ts_console_log_debug", "Console.log Debug Left In Code", "Low", "FunctionBody", "i", r"console\.log\s*\([^)]*(?:debug|DEBUG|trace|TRACE|test|TEST)[^)]*\)", ["debug", "console"], "console.log"),
    ("ts_premature_return_null", "Premature Return Null/Undefined", "High", "FunctionBody", "i", r"return\s+(?:null|undefined)\s*(?:;\s*)?(?://.*(?:for now|temporary|placeholder|stub)|$)", ["premature_return", "fake_success", "ai_patterns"], "return"),
    ("ts_fake_authentication", "Fake Authentication Logic", "Critical", "FunctionBody", "i", r"(?:authenticate|verify|check|validate).*(?:return\s+true|true\s*(?://.*(?:for now|temporary|placeholder|fake)|;|$))", ["security", "authentication", "fake_logic", "ai_patterns"], "true"),
    ("ts_settimeout_as_implementation", "setTimeout as Implementation", "High", "FunctionBody", "i", r"(?:setTimeout|delay)\s*\([^,)]+(?:,\s*[^)]+)?\)\s*(?://.*(?:simulate|mock|fake|placeholder|for now)|;)", ["fake_async", "timeout", "placeholder", "ai_patterns"], "("),
    ("ts_error_suppression", "Silent Error Suppression", "High", "FunctionBody", None, r"catch\s*\([^)]*\)\s*\{\s*(?://.*(?:ignore|suppress|silence|todo)|\}|console\.log\([^)]*\);?\s*\})", ["error_handling", "suppression", "ai_patterns"], "catch"),
    ("ts_mock_data_return", "Mock Data Return", "Medium", "FunctionBody", "i", r"""return\s+(?:\[.*\]|\{.*\}|["'][^"']*(?:test|mock|fake|sample|dummy)[^"']*["']|\d+)\s*(?:;\s*)?(?://.*(?:mock|fake|test|sample|dummy|placeholder)|$)""", ["mock_data", "fake_return", "ai_patterns"], "return"),
    ("ts_generic_error_messages", "Generic Error Messages", "Medium", "FunctionBody", "i", r"""(?:throw|Error|new\s+Error)\s*\(\s*["'](?:error|failed|something went wrong|oops|todo|fixme)["']\s*\)""", ["error_handling", "generic", "unhelpful", "ai_patterns"], "("),
    ("ts_promise_resolve_placeholder", "Promise Resolve Placeholder", "Medium", "FunctionBody", "i", r"(?:Promise\.resolve|resolve)\s*\(\s*(?:null|undefined|0|''|\[\]|\{\})\s*\)\s*(?://.*(?:placeholder|temporary|for now|stub)|;|$)", ["promise", "placeholder", "fake_async", "ai_patterns"], "resolve"),
    ("ts_copy_paste_patterns", "Copy-Paste Code Patterns", "Low", "Comments", "i", r"(?://\s*(?:same as above|copy of|duplicate|repeated|clone))", ["duplication", "copy_paste", "ai_patterns"], "//"),
]
_EMPTY = ("js_empty_function", "Empty Function", "High", "FunctionBody", None, r"function\s+\w+\s*\([^)]*\)\s*\{\s*\}", ["placeholder", "incomplete"], "function")
BUILTIN = {
    "rust": [
        RUST[0],
        RUST[1],
        ("rust_panic_with_todo", "Panic with TODO", "High", "FunctionBody", "i", r'panic!\s*\(\s*"[^"]*(?:TODO|FIXME|XXX|placeholder|not implemented)[^"]*"\s*\)', ["panic", "placeholder"], "panic!"),
        RUST[3],
    ],
    "python": [PYTHON[1], PYTHON[0], PYTHON[2]],
    "javascript": [_EMPTY],
    "typescript": [_EMPTY],
}
SHIPPED = {"rust": RUST, "python": PYTHON, "typescript": TYPESCRIPT}
