"""Grammars of the supported languages, dialects side by side, for the generalised parser.

They decide validity only, so operators have no ranks.
"""

_JS_CORE = r"""
Program: Item*
Item: Stmt | Import | Export
Stmts: Stmt*
Block: {:Stmts}
End: ';' | @asi
Stmt: Block | ';' | Var End | 'if' (:Expr) Stmt ('else' Stmt)? | 'for' 'await'? (:ForHead) Stmt | 'while' (:Expr) Stmt
  | 'do' Stmt 'while' (:Expr) ';'? | 'continue' Id? End | 'break' Id? End | 'return' Expr? End | 'throw' Expr End
  | 'try' Block ('catch' (:CatchHead)? Block ('finally' Block)? | 'finally' Block)
  | 'switch' (:Expr) {:Cases} | Id ':' Stmt | FuncDecl | ClassDecl | 'debugger' End | @exprstart Expr End | TsStmt
Cases: (('case' Expr | 'default') ':' Stmt*)*
Var: ('var' | 'let' | 'const' | 'using') Decl (',' Decl)*
Decl: Target Ann? ('=' Assign)?
Target: Id | [:ArrPat] | {:ObjPat}
Place: Target | Member
Member: Primary Suffix* ('.' Name | '?.' Name | [:Expr] | '!')
Expr: Assign (',' Assign)*
Assign: Arrow | 'yield' '*'? Assign? | Cond | Place AssignOp Assign | Operand '=' Assign @never
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
Cond: Operand (BinOp Operand | AsType)* ('?' Assign ':' Assign)?
BinOp: '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof'
Operand: Prefix* Postfix | Priv
Prefix: '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | Angle
Postfix: Primary Suffix* ('++' | '--')?
Suffix: '.' (Name | Priv) | '?.' (Name | Priv | [:Expr] | (:Args) | TypeArgs (:Args)) | [:Expr] | (:Args) | 'TPL' | '!' | TypeArgs (:Args) | TypeArgs 'TPL'
Primary: Id | 'NUM' | 'STR' | 'TPL' | 'REGEX' | 'JSX' | 'this' | 'super' | 'null' | 'true' | 'false' | (:Expr) | [:ArrLit] | {:ObjLit} | Func | Class
  | 'new' Primary TypeArgs? | 'new' '.' Name | 'import' (:Args) | 'import' '.' Name | '@' Postfix Class
Arrow: 'async'? (Id | TypeParams? (:Params) Ann?) '=>' (Block | @arrowexpr Assign)
Func: 'async'? 'function' '*'? Id? TypeParams? (:Params) Ann? Block
FuncDecl: 'async'? 'function' '*'? Id TypeParams? (:Params) Ann? Block
Class: 'class' Id? TypeParams? Heritage {:ClassBody}
ClassDecl: Deco* 'class' Id TypeParams? Heritage {:ClassBody}
Deco: '@' Postfix
Heritage: ('extends' Postfix TypeArgs?)? Implements?
ClassBody: (ClassItem | ';')*
ClassItem: Deco* Modifier* (('get' | 'set') PropName (:Params) Ann? Body | 'async'? '*'? PropName '?'? TypeParams? (:Params) Ann? Body | PropName FieldMark? Ann? ('=' Assign)? End | TsMember) | 'static' Block
Body: Block | TsNoBody
PropName: Name | 'STR' | 'NUM' | [:Assign] | Priv
ObjLit: (Prop (',' Prop)* ','?)?
Prop: PropName ':' Assign | Id | '...' Assign | ('get' | 'set') PropName (:Params) Ann? Block | 'async'? '*'? PropName TypeParams? (:Params) Ann? Block
ObjPat: (PatProp (',' PatProp)* ','?)?
PatProp: Id ('=' Assign)? | PropName ':' Place ('=' Assign)? | '...' Place
ArrLit: ','* (Elem (','+ Elem)* ','*)?
Elem: '...'? Assign
ArrPat: ','* (PatElem (','+ PatElem)* ','*)?
PatElem: '...'? Place ('=' Assign)?
Args: (Elem (',' Elem)* ','?)?
Params: (Param (',' Param)* ','?)?
Param: Deco* ParamMark* '...'? (Target | ThisParam) Optional? Ann? ('=' Assign)?
ForHead: (Var | Expr)? ';' Expr? ';' Expr? | ('var' | 'let' | 'const')? Place ('of' Assign | 'in' Expr)
CatchHead: Target Ann?
Import: 'import' 'STR' With? End | 'import' TypeWord? ImportClause 'from' 'STR' With? End | TsImport
With: ('with' | 'assert') {:ObjLit}
ImportClause: Id (',' (Star | {:ImportList}))? | Star | {:ImportList}
Star: '*' 'as' Id
ImportList: (Spec (',' Spec)* ','?)?
Spec: TypeWord? (Name | 'STR') ('as' (Name | 'STR'))?
Export: 'export' (TypeWord? {:ImportList} ('from' 'STR' With?)? End | TypeWord? '*' ('as' (Name | 'STR'))? 'from' 'STR' With? End | 'default' (Func | Deco* AbstractWord? Class | TsInterface | @exprstart Assign End) | Var End | FuncDecl | ClassDecl | TsExport)
  | Deco+ 'export' 'default'? Class
Id: 'ID'
Name: 'ID' | 'WORD'
Priv: 'PRIV'
"""
_JS_ONLY = r"""
TsStmt: @never
TsMember: @never
TsNoBody: @never
TsImport: @never
TsExport: @never
TsInterface: @never
Ann: @never
AsType: @never
Angle: @never
TypeArgs: @never
TypeParams: @never
Implements: @never
ParamMark: @never
ThisParam: @never
Optional: @never
FieldMark: @never
TypeWord: @never
AbstractWord: @never
Modifier: 'static'
"""
_TS_ONLY = r"""
TsStmt: TsInterface | TypeAlias | Enum | Namespace | 'abstract' ClassDecl | 'declare' TsDeclared | FuncHead End
TsDeclared: Var End | FuncHead End | 'abstract'? ClassDecl | TsInterface | TypeAlias | Enum | Namespace | 'global' {:Program}
FuncHead: 'async'? 'function' '*'? Id TypeParams? (:Params) Ann?
TsInterface: 'interface' Id TypeParams? ('extends' TypeRef (',' TypeRef)*)? {:TypeBody}
TypeAlias: 'type' Id TypeParams? '=' Type End
Enum: 'const'? 'enum' Id {:EnumBody}
EnumBody: (EnumItem (',' EnumItem)* ','?)?
EnumItem: PropName ('=' Assign)?
Namespace: ('namespace' | 'module') (Id ('.' Id)* | 'STR') {:Program}
TsMember: [:IndexSig] Ann End
TsNoBody: End
TsImport: 'import' TypeWord? Id '=' ('require' (:Args) | Id ('.' Name)*) End
TsExport: TsStmt | '=' Expr End | 'as' 'namespace' Id End | 'import' Id '=' Id ('.' Name)* End
Ann: ':' (Type | 'asserts'? (Id | 'this') 'is' Type | 'asserts' (Id | 'this'))
AsType: ('as' | 'satisfies') Type
Angle: '<' Type '>'
TypeArgs: '<' Type (',' Type)* '>'
TypeParams: '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam: ('const' | 'in' | 'out')* Id ('extends' Type)? ('=' Type)?
Implements: 'implements' TypeRef (',' TypeRef)*
ParamMark: 'public' | 'private' | 'protected' | 'readonly' | 'override'
ThisParam: 'this'
Optional: '?'
FieldMark: '?' | '!'
TypeWord: 'type' | 'typeof'
AbstractWord: 'abstract'
Modifier: 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override' | 'accessor'
Type: ('|' | '&')? TypeOp (('|' | '&') TypeOp)* ('extends' Type '?' Type ':' Type)? | TypeParams? (:Params) '=>' (Type | 'asserts'? (Id | 'this') 'is' Type) | 'abstract'? 'new' TypeParams? (:Params) '=>' Type
TypeOp: ('keyof' | 'readonly' | 'unique' | 'infer')* TypeAtom ([:Nothing] | [:Type])*
TypeAtom: TypeRef | 'STR' | 'NUM' | '-' 'NUM' | 'TPL' | 'null' | 'true' | 'false' | 'this' | 'void' | 'typeof' (Id | 'this') ('.' Name)* TypeArgs? | {:TypeBody} | [:Tuple] | (:Type) | 'typeof'? 'import' (:Args) ('.' Name)* TypeArgs?
TypeRef: Id ('.' Name)* TypeArgs?
Nothing: @end
TypeBody: (TypeItem (';' | ',' | @asi))*
TypeItem: ('+' | '-')? 'readonly'? (('get' | 'set')? PropName '?'? Ann? | ('get' | 'set')? PropName '?'? TypeParams? (:Params) Ann? | [:IndexSig] (('+' | '-')? '?')? Ann) | 'new'? TypeParams? (:Params) Ann?
IndexSig: Id ':' Type | Id 'in' Type ('as' Type)?
Tuple: (TupleItem (',' TupleItem)* ','?)?
TupleItem: '...'? (Name '?'? ':')? Type '?'?
"""
JS = _JS_CORE + _JS_ONLY
TS = _JS_CORE + _TS_ONLY

JAVA = r"""
Unit: (Anno* 'package' QName ';')? (Import | ';')* (TypeDecl | ';')* | (Import | ';')* Anno* 'open'? 'module' QName {:ModuleBody}
ModuleBody: (('requires' ('transitive' | 'static')* | 'exports' | 'opens' | 'uses' | 'provides') QName (('to' | 'with') QName (',' QName)*)? ';')*
Import: 'import' ('static' | 'module')? QName ('.' '*')? ';'
QName: Id ('.' Id)*
TypeDecl: Mods (ClassDecl | InterfaceDecl | EnumDecl | RecordDecl | AnnoDecl)
Mods: (Anno | Modifier)*
Modifier: 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
Anno: '@' QName (:AnnoArgs)?
AnnoArgs: (AnnoArg (',' AnnoArg)*)?
AnnoArg: (Id '=')? ElemVal
ElemVal: Expr | {:ElemVals} | Anno
ElemVals: (ElemVal (',' ElemVal)* ','?)?
ClassDecl: 'class' Id TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? {:ClassBody}
InterfaceDecl: 'interface' Id TParams? ('extends' Types)? ('permits' Types)? {:ClassBody}
EnumDecl: 'enum' Id ('implements' Types)? {:EnumBody}
RecordDecl: 'record' Id TParams? (:Params) ('implements' Types)? {:ClassBody}
AnnoDecl: '@' 'interface' Id {:ClassBody}
ClassBody: Member*
Member: ';' | 'static'? Block | TypeDecl | Mods TParams? Anno* ResultType Id (:Params) Dims ('throws' Types)? (Block | ';' | 'default' ElemVal ';') | Mods TParams? Id (:Params) ('throws' Types)? Block | Mods Type VarDecl (',' VarDecl)* ';' | Mods Id Block
ResultType: Type | 'void'
VarDecl: Id Dims ('=' VarInit)?
VarInit: Expr | {:ArrInit}
ArrInit: (VarInit (',' VarInit)* ','?)? | ','
Dims: (Anno* [:Nothing])*
Nothing: @end
EnumBody: (EnumItem (',' EnumItem)* ','?)? (';' Member*)?
EnumItem: Anno* Id (:Args)? {:ClassBody}?
Types: Type (',' Type)*
Type: Anno* ('PRIM' | ClassType) Dims
ClassType: Id TArgs? ('.' Anno* Id TArgs?)*
TArgs: '<' (TArg (',' TArg)*)? '>'
TArg: Anno* (Type | '?' (('extends' | 'super') Type)?)
TParams: '<' TParam (',' TParam)* '>'
TParam: Anno* Id ('extends' Type ('&' Type)*)?
Params: (Param (',' Param)*)?
Param: Mods Type Anno* '...'? Id Dims | Mods Type (Id '.')? 'this'
Block: {:Stmts}
Stmts: Stmt*
Stmt: Block | ';' | Local ';' | TypeDecl | 'if' (:Expr) Stmt ('else' Stmt)? | 'for' (:ForHead) Stmt | 'while' (:Expr) Stmt | 'do' Stmt 'while' (:Expr) ';'
  | 'try' ((:Resources) Block Catch* ('finally' Block)? | Block (Catch+ ('finally' Block)? | 'finally' Block)) | 'switch' (:Expr) {:SwitchBody} | 'return' Expr? ';' | 'throw' Expr ';'
  | 'break' Id? ';' | 'continue' Id? ';' | 'yield' Expr ';' | 'synchronized' (:Expr) Block | 'assert' Expr (':' Expr)? ';' | Id ':' Stmt | StmtExpr ';'
Catch: 'catch' (:CatchHead) Block
CatchHead: Mods Type ('|' Type)* Id
Resources: Resource (';' Resource)* ';'?
Resource: Mods Type Id '=' Expr | Expr
Local: Mods Type VarDecl (',' VarDecl)*
ForHead: (Local | StmtExpr (',' StmtExpr)*)? ';' Expr? ';' (StmtExpr (',' StmtExpr)*)? | Mods Type Id ':' Expr
SwitchBody: (Label ':' Stmt*)* | (Label '->' (StmtExprAny ';' | Block | 'throw' Expr ';'))*
Label: 'case' CaseItem (',' CaseItem)* ('when' Expr)? | 'default'
CaseItem: Cond | Pattern | 'default'
StmtExprAny: Expr
StmtExpr: Unary AssignOp Expr | ('++' | '--') Unary | Postfix ('++' | '--') | Primary Suffix* (:Args) | ('super' | 'this') (:Args) | Creation Suffix* | Id (:Args)
Expr: Lambda | Cond | Unary AssignOp Expr
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
Cond: Operand (BinOp Operand | 'instanceof' ('final'? Type Id? | Pattern))* ('?' Expr ':' (Cond | Lambda))?
Pattern: Mods Type (:Patterns) Id? | Mods Type Id
Patterns: (Pattern (',' Pattern)*)?
BinOp: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||'
Operand: Unary
Unary: ('+' | '-' | '!' | '~' | '++' | '--') Unary | (:CastType) (Unary | Lambda) | Postfix
CastType: Type ('&' Type)*
Postfix: Primary Suffix* ('++' | '--')?
Suffix: '.' (TArgs? Id | 'class' | 'this' | 'super' | TArgs? 'super' | Creation) | [:Expr] | (:Args) | '::' TArgs? (Id | 'new')
Primary: Id | 'NUM' | 'STR' | 'true' | 'false' | 'null' | 'this' | 'super' | (:Expr) | Creation | 'switch' (:Expr) {:SwitchBody} | 'PRIM' Dims ('.' 'class' | '::' 'new') | 'void' '.' 'class' | ClassType Dims '::' TArgs? (Id | 'new') | ClassType [:Nothing] Dims '.' 'class'
Creation: 'new' TArgs? Anno* ClassType (:Args) {:ClassBody}? | 'new' Anno* ('PRIM' | ClassType) ([:Expr]+ Dims | [:Nothing] Dims {:ArrInit})
Lambda: (Id | (:LambdaParams)) '->' (Block | Expr)
LambdaParams: (Id (',' Id)*)? | Params
Args: (Expr (',' Expr)*)?
Id: 'ID'
"""

GO = r"""
File: Package (';'+ Import)* (';'+ TopDecl)* ';'*
Package: 'package' Id
Import: 'import' (ImportSpec | (:ImportSpecs))
ImportSpecs: (ImportSpec (';' ImportSpec)* ';'?)?
ImportSpec: ('.' | Id)? 'STR'
TopDecl: Decl | FuncDecl
Decl: 'const' (Spec | (:Specs)) | 'var' (Spec | (:Specs)) | 'type' (TypeSpec | (:TypeSpecs))
Specs: (Spec (';' Spec)* ';'?)?
Spec: Ids Type? ('=' Exprs)?
TypeSpecs: (TypeSpec (';' TypeSpec)* ';'?)?
TypeSpec: Id [:TypeParams]? '='? Type
Ids: Id (',' Id)*
FuncDecl: 'func' (:Params)? Id [:TypeParams]? (:Params) Result? Block?
TypeParams: Ids Constraint (',' Ids Constraint)* ','?
Constraint: '~'? Type ('|' '~'? Type)*
Result: (:Params) | Type
Params: (Param (',' Param)* ','?)?
Param: Id? '...'? Type
Type: Id ('.' Id)? [:TypeList]? | '*' Type | [:Nothing] Type | [:ArrLen] Type | 'map' [:Type] Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' (:Params) Result? | 'struct' {:Fields} | 'interface' {:Methods} | (:Type)
TypeList: Type (',' Type)* ','?
ArrLen: Expr | '...'
Nothing: @end
Fields: (Field (';' Field)* ';'?)?
Field: Ids Type 'STR'? | '*'? Id ('.' Id)? [:TypeList]? 'STR'?
Methods: (Method (';' Method)* ';'?)?
Method: Id (:Params) Result? | Constraint
Block: {:Stmts}
Stmts: Stmt? (';' Stmt?)*
Stmt: Decl | 'return' Exprs? | If | 'for' ForClause? Block | 'switch' ((Simple? ';')? (Expr | Simple)? | Simple? ';') {:Cases} | 'select' {:Cases} | 'go' Expr | 'defer' Expr | 'break' Id? | 'continue' Id? | 'goto' Id | 'fallthrough' | Id ':' Stmt? | Block | Simple
If: 'if' (Simple? ';')? Expr Block ('else' (If | Block))?
ForClause: Expr | Simple? ';' Expr? ';' Simple? | (Exprs ('=' | ':='))? 'range' Expr
Cases: (('case' CaseItems | 'default') ':' Stmts)*
CaseItems: (Type | Expr) (',' (Type | Expr))* | Simple
Simple: Exprs (AssignOp Exprs | '++' | '--' | '<-' Expr)?
AssignOp: '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
Exprs: Expr (',' Expr)*
Expr: Unary (BinOp Unary)*
BinOp: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '&' | '|' | '^' | '&^' | '&&' | '||'
Unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')* Primary Suffix*
Suffix: '.' Id | '.' (:Asserted) | [:Index] | (:Args) | {:Literal}
Asserted: Type | 'type'
Index: Expr (',' Expr)* ','? | Type (',' Type)* | Expr? ':' Expr? (':' Expr)?
Primary: Id | 'NUM' | 'STR' | (:Grouped) | 'func' (:Params) Result? Block | LitType {:Literal} | ConvType (:Args)
Grouped: Expr | Type
LitType: [:Nothing] Type | [:ArrLen] Type | 'map' [:Type] Type | 'struct' {:Fields}
ConvType: [:Nothing] Type | [:ArrLen] Type | 'map' [:Type] Type | 'chan' '<-'? Type | 'func' (:Params) Result? | 'interface' {:Methods} | 'struct' {:Fields}
Literal: (Element (',' Element)* ','?)?
Element: (Value ':')? Value
Value: Expr | {:Literal}
Args: (Arg (',' Arg)* ','?)?
Arg: (Expr | Type) '...'?
Id: 'ID'
"""

PYTHON = r"""
File: Stmt*
Stmts: Stmt+
Stmt: Simple (';' Simple)* ';'? 'NL' | Compound
Suite: ':' ('NL' <:Stmts> | Simple (';' Simple)* ';'? 'NL')
Compound: 'if' Named Suite ('elif' Named Suite)* ('else' Suite)? | 'while' Named Suite ('else' Suite)? | 'async'? 'for' Targets 'in' Stars Suite ('else' Suite)?
  | 'try' Suite (Except+ ('else' Suite)? ('finally' Suite)? | 'finally' Suite) | 'async'? 'with' (WithItem (',' WithItem)* | (:WithItems)) Suite
  | ('@' Named 'NL')* ('async'? 'def' Id [:TypeParams]? (:Params) ('->' Expr)? Suite | 'class' Id [:TypeParams]? (:Args)? Suite)
  | 'match' Stars ':' 'NL' <:Cases>
Except: 'except' (Stars ('as' Id)?)? Suite | 'except' '*' Stars ('as' Id)? Suite
WithItem: Expr ('as' Target)?
WithItems: WithItem (',' WithItem)* ','?
Cases: ('case' Patterns ('if' Named)? Suite)+
Patterns: Pattern (',' Pattern)* ','?
Pattern: ('*' Id | PatOr) ('as' Id)?
PatOr: PatAtom ('|' PatAtom)*
PatAtom: Id ('.' Id)* (:PatArgs)? | '-'? 'NUM' (('+' | '-') 'NUM')? | 'STR'+ | 'None' | 'True' | 'False' | (:PatGroup) | [:PatGroup] | {:PatMap}
PatGroup: Patterns?
PatArgs: (PatArg (',' PatArg)* ','?)?
PatArg: (Id '=')? Pattern
PatMap: (PatPair (',' PatPair)* ','?)?
PatPair: PatOr ':' Pattern | '**' Id
Simple: 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (Expr ('from' Expr)?)? | 'global' Ids | 'nonlocal' Ids | 'del' Targets | 'assert' Expr (',' Expr)? | Import | 'type' Id [:TypeParams]? '=' Expr | Yield
  | Stars | (Targets '=')+ (Stars | Yield) | Single AugOp (Stars | Yield) | (Single | (:Single)) ':' Expr ('=' (Stars | Yield))?
Ids: Id (',' Id)*
Import: 'import' Dotted ('as' Id)? (',' Dotted ('as' Id)?)* | 'from' ('.' | '...')* Dotted? 'import' ('*' | Names | (:NameList)) @never | 'from' (('.' | '...')+ Dotted? | Dotted) 'import' ('*' | Names | (:NameList))
Names: Id ('as' Id)? (',' Id ('as' Id)?)*
NameList: Names ','?
Dotted: Id ('.' Id)*
AugOp: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Single: Id | Reach
Reach: Primary Suffix* ('.' Id | [:Subs])
Target: Id | Reach | (:TargetGroup) | [:TargetGroup]
Targets: '*'? Target (',' '*'? Target)* ','?
TargetGroup: Targets?
Yield: 'yield' ('from' Expr | Stars)?
Stars: Star (',' Star)* ','?
Star: '*' Expr | Named
Named: Id ':=' Expr | Expr
Expr: 'lambda' LambdaParams? ':' Expr | Flat ('if' Flat 'else' Expr)?
Flat: Operand (BinOp Operand)*
BinOp: 'or' | 'and' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '^' | '|' | '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
Operand: ('not' | '-' | '+' | '~' | 'await')* Primary Suffix*
Suffix: '.' Id | [:Subs] | (:Args)
Primary: Id | 'NUM' | 'STR'+ | 'None' | 'True' | 'False' | '...' | (:Paren) | [:List] | {:Braces}
Paren: Stars? | Named Comp | Yield
List: Stars? | Named Comp
Braces: (Pair (',' Pair)* ','?)? | Expr ':' Expr Comp | Stars | Named Comp
Pair: Expr ':' Expr | '**' Expr
Comp: ('async'? 'for' Targets 'in' Flat ('if' Cond)*)+
Cond: Id ':=' Flat | Flat | 'lambda' LambdaParams? ':' Cond
Args: (Arg (',' Arg)* ','?)?
Arg: Id '=' Expr | '*' Expr | '**' Expr | Named Comp?
Subs: Sub (',' Sub)* ','?
Sub: Expr? ':' Expr? (':' Expr?)? | Named | '*' Expr
Params: (Param (',' Param)* ','?)?
Param: Id (':' Expr)? ('=' Expr)? | '*' (Id (':' ('*' Expr | Expr))?)? | '**' Id (':' Expr)? | '/'
LambdaParams: LambdaParam (',' LambdaParam)* ','?
LambdaParam: Id ('=' Expr)? | '*' Id? | '**' Id | '/'
TypeParams: TypeParam (',' TypeParam)* ','?
TypeParam: ('*' | '**')? Id (':' Expr)? ('=' Expr)?
Id: 'ID'
"""
