"""Queries over all letters of the dispatch tables: each kind that the parser can make, printed and encoded again.

A case is a kind (or several), a symbol and its printed text; it is run for every nation. In both, {b} stands for the mangled region and nation, {m} and {n} for one of them,
{q} for the two printed with a dot, {r} for the region. Names with a space are encoded in punycode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import symbols as S
from ..kernel.tree import Tree

#: Families of cases that differ in an operator: how the symbol and the text are built around it, and lines of kind, operator and text. Fixed values of the format.
FAMILIES = {
    "accessors": (
        "$s{b}V1aSiv{op}",
        "{q}.a.{text} : Swift.Int",
        """
materializeForSet m materializeForSet
globalGetter G getter
read2Accessor y read2
modify2Accessor x modify2
initAccessor i init
borrowAccessor b borrow
mutateAccessor z mutate
owningMutableAddressor aO owningMutableAddressor
nativeOwningMutableAddressor ao nativeOwningMutableAddressor
nativePinningMutableAddressor aP nativePinningMutableAddressor
unsafeMutableAddressor au unsafeMutableAddressor
owningAddressor lO owningAddressor
nativeOwningAddressor lo nativeOwningAddressor
nativePinningAddressor lp nativePinningAddressor
unsafeAddressor lu unsafeAddressor
""",
    ),
    "macros": (
        "$s{b}V1a3FoofM{op}_",
        "{text} macro @Foo expansion #1 of a in {q}",
        """
accessorAttachedMacroExpansion a accessor
memberAttributeAttachedMacroExpansion r memberAttribute
memberAttachedMacroExpansion m member
peerAttachedMacroExpansion p peer
conformanceAttachedMacroExpansion c conformance
extensionAttachedMacroExpansion e extension
preambleAttachedMacroExpansion q preamble
bodyAttachedMacroExpansion b body
""",
    ),
    "witnesses": (
        "$s{b}VSHs{op}",
        "{text} {q} : Swift.Hashable in Swift",
        """
reflectionMetadataAssocTypeDescriptor MA reflection metadata associated type descriptor
protocolWitnessTablePattern Wp protocol witness table pattern for
genericProtocolWitnessTable WG generic protocol witness table for
genericProtocolWitnessTableInstantiationFunction WI instantiation function for generic protocol witness table for
resilientProtocolWitnessTable Wr resilient protocol witness table for
protocolWitnessTableAccessor Wa protocol witness table accessor for
associatedTypeMetadataAccessor 1TWt associated type metadata accessor for T in
baseWitnessTableAccessor SQWb base witness table accessor for Swift.Equatable in
""",
    ),
    "function_marks": (
        "$s{b}yyF{op}",
        "{text} {q}() -> ()",
        """
silThunkIdentity TTI identity thunk of
outlinedVariable Tv0_ outlined variable #1 of
backDeploymentThunk Twb back deployment thunk for
backDeploymentFallback TwB back deployment fallback for
hasSymbolQuery TwS #_hasSymbol query for
coroFunctionPointer Twc coro function pointer to
defaultOverride Twd default override of
distributedAccessor TF distributed accessor for
dynamicallyReplaceableFunctionImpl TI dynamically replaceable thunk for
dynamicallyReplaceableFunctionKey Tx dynamically replaceable key for
partialApplyObjCForwarder Ta partial apply ObjC forwarder for
outlinedReadOnlyObject Tv_r outlined read-only object #0 of
representationChanged Tfr5 function signature specialization <> of
""",
    ),
    "structures": (
        "$s{b}V{op}",
        "{text} {q}",
        """
canonicalSpecializedGenericTypeMetadataAccessFunction Mb canonical specialized generic type metadata accessor for
typeMetadataDemanglingCache MD demangling cache variable for type metadata for
typeMetadataMangledNameRef MR mangled name ref for type metadata for
opaqueTypeDescriptorAccessor Mg opaque type descriptor accessor for
opaqueTypeDescriptorAccessorImpl Mh opaque type descriptor accessor impl for
opaqueTypeDescriptorAccessorKey Mj opaque type descriptor accessor key for
noncanonicalSpecializedGenericTypeMetadataCache MJ cache variable for noncanonical specialized generic type metadata for
opaqueTypeDescriptorAccessorVar Mk opaque type descriptor accessor var for
metadataInstantiationCache MK metadata instantiation cache for
typeMetadataLazyCache ML lazy cache variable for type metadata for
canonicalSpecializedGenericMetaclass MM specialized generic metaclass for
noncanonicalSpecializedGenericTypeMetadata MN noncanonical specialized generic type metadata for
uniquable Mq uniquable
opaqueTypeDescriptor MQ opaque type descriptor for
canonicalPrespecializedGenericTypeCachingOnceToken Mz flag for loading of canonical specialized generic type metadata for
anonymousDescriptor MXX anonymous descriptor
coroutineContinuationPrototype TC coroutine continuation prototype for
silBoxType XbD @box
shared h __shared
owned nD __owned
isolated YiD isolated
noDerivative YkD @noDerivative
compileTimeLiteral YtD _const
sending YuD sending
constValue YgD @const
outlinedInitializeWithTakeNoValueWitness WOB outlined init with take of
outlinedInitializeWithCopyNoValueWitness WOC outlined init with copy of
outlinedAssignWithTakeNoValueWitness WOD outlined assign with take of
outlinedAssignWithCopyNoValueWitness WOF outlined assign with copy of
outlinedDestroyNoValueWitness WOH outlined destroy of
outlinedEnumGetTag WOg outlined enum get tag of
""",
    ),
    "classes": (
        "$s{b}C{op}",
        "{text} {q}",
        """
objCResilientClassStub Ms ObjC resilient class stub for
fullObjCResilientClassStub Mt full ObjC resilient class stub for
reflectionMetadataSuperclassDescriptor MC reflection metadata superclass descriptor
methodLookupFunction Mu method lookup function for
""",
    ),
    "standard_types": (
        "$s{b}V_S{op}tD",
        "({q}, {text})",
        """
structure a Swift.Array
structure A Swift.AutoreleasingUnsafeMutablePointer
structure b Swift.Bool
structure D Swift.Dictionary
structure d Swift.Double
structure f Swift.Float
structure h Swift.Set
structure I Swift.DefaultIndices
structure i Swift.Int
structure J Swift.Character
structure N Swift.ClosedRange
structure n Swift.Range
structure O Swift.ObjectIdentifier
structure p Swift.UnsafeMutablePointer
structure P Swift.UnsafePointer
structure R Swift.UnsafeBufferPointer
structure r Swift.UnsafeMutableBufferPointer
structure S Swift.String
structure s Swift.Substring
structure u Swift.UInt
structure v Swift.UnsafeMutableRawPointer
structure V Swift.UnsafeRawPointer
structure W Swift.UnsafeRawBufferPointer
structure w Swift.UnsafeMutableRawBufferPointer
enum q Swift.Optional
structure cC Swift.CheckedContinuation
structure cc Swift.UnsafeContinuation
structure cE Swift.CancellationError
structure ce Swift.UnownedSerialExecutor
structure cG Swift.TaskGroup
structure cg Swift.ThrowingTaskGroup
structure cJ Swift.UnownedJob
class cM Swift.MainActor
structure cP Swift.TaskPriority
structure cS Swift.AsyncStream
structure cs Swift.AsyncThrowingStream
structure cT Swift.Task
structure ct Swift.UnsafeCurrentTask
""",
    ),
    "standard_protocols": (
        "$s{b}V_S{op}_ptD",
        "({q}, {text})",
        """
protocol B Swift.BinaryFloatingPoint
protocol E Swift.Encodable
protocol e Swift.Decodable
protocol F Swift.FloatingPoint
protocol G Swift.RandomNumberGenerator
protocol H Swift.Hashable
protocol j Swift.Numeric
protocol K Swift.BidirectionalCollection
protocol k Swift.RandomAccessCollection
protocol L Swift.Comparable
protocol l Swift.Collection
protocol M Swift.MutableCollection
protocol m Swift.RangeReplaceableCollection
protocol Q Swift.Equatable
protocol T Swift.Sequence
protocol t Swift.IteratorProtocol
protocol U Swift.UnsignedInteger
protocol X Swift.RangeExpression
protocol x Swift.Strideable
protocol Y Swift.RawRepresentable
protocol y Swift.StringProtocol
protocol Z Swift.SignedInteger
protocol z Swift.BinaryInteger
protocol cA Swift.Actor
protocol cF Swift.Executor
protocol cf Swift.SerialExecutor
protocol ch Swift.TaskExecutor
protocol cI Swift.AsyncIteratorProtocol
protocol ci Swift.AsyncSequence
""",
    ),
    "builtins": (
        "$s{b}V_B{op}tD",
        "({q}, {text})",
        """
builtinTypeName A Builtin.ImplicitActor
builtinTypeName b Builtin.BridgeObject
builtinTypeName B Builtin.UnsafeValueBuffer
builtinTypeName e Builtin.Executor
builtinTypeName I Builtin.IntLiteral
builtinTypeName O Builtin.UnknownObject
builtinTypeName o Builtin.NativeObject
builtinTypeName p Builtin.RawPointer
builtinTypeName t Builtin.SILToken
builtinTypeName w Builtin.Word
builtinTypeName c Builtin.RawUnsafeContinuation
builtinTypeName D Builtin.DefaultActorStorage
builtinTypeName d Builtin.NonDefaultDistributedActorStorage
builtinTypeName j Builtin.Job
builtinTypeName P Builtin.PackIndex
builtinTypeName f32_ Builtin.FPIEEE32
builtinTypeName f64_ Builtin.FPIEEE64
builtinTypeName i1_ Builtin.Int1
builtinTypeName i32_ Builtin.Int32
builtinTypeName pBv4_ Builtin.Vec4xRawPointer
builtinTypeName i8_Bv16_ Builtin.Vec16xInt8
""",
    ),
    "conventions_of_parameters": (
        "$s{b}VIeg{op}_D",
        "@escaping @callee_guaranteed ({text} {q}) -> ()",
        """
implParameter i @in
implParameter c @in_constant
implParameter l @inout
implParameter b @inout_aliasable
implParameter n @in_guaranteed
implParameter X @in_cxx
implParameter x @owned
implParameter g @guaranteed
implParameter e @deallocating
implParameter y @unowned
implParameter v @pack_owned
implParameter p @pack_guaranteed
implParameter m @pack_inout
""",
    ),
    "conventions_of_results": (
        "$s{b}VIeg{op}_D",
        "@escaping @callee_guaranteed () -> ({text} {q})",
        """
implResult r @out
implResult o @owned
implResult d @unowned
implResult u @unowned_inner_pointer
implResult a @autoreleased
implResult k @pack_out
""",
    ),
    "callees": (
        "$s{b}VIe{op}y_D",
        "@escaping {text} (@unowned {q}) -> ()",
        """
implConvention y @callee_unowned
implConvention g @callee_guaranteed
implConvention x @callee_owned
implConvention t @convention(thin)
implConvention yB @callee_unowned @convention(block)
implConvention yC @callee_unowned @convention(c)
implConvention yM @callee_unowned @convention(method)
implConvention yO @callee_unowned @convention(objc_method)
implConvention yK @callee_unowned @convention(closure)
implConvention yW @callee_unowned @convention(witness_method)
implConvention tMA @convention(thin) @convention(method) @yield_once
implConvention tMI @convention(thin) @convention(method) @yield_once_2
implConvention tMG @convention(thin) @convention(method) @yield_many
""",
    ),
    "value_witnesses": (
        "$s{b}Vw{op}",
        "{text} value witness for {q}",
        """
valueWitness al allocateBuffer
valueWitness ca assignWithCopy
valueWitness ta assignWithTake
valueWitness de deallocateBuffer
valueWitness xx destroy
valueWitness Xx destroyArray
valueWitness XX destroyBuffer
valueWitness CP initializeBufferWithCopyOfBuffer
valueWitness Cp initializeBufferWithCopy
valueWitness cp initializeWithCopy
valueWitness Tk initializeBufferWithTake
valueWitness tk initializeWithTake
valueWitness pr projectBuffer
valueWitness TK initializeBufferWithTakeOfBuffer
valueWitness Cc initializeArrayWithCopy
valueWitness Tt initializeArrayWithTakeFrontToBack
valueWitness tT initializeArrayWithTakeBackToFront
valueWitness xs storeExtraInhabitant
valueWitness xg getExtraInhabitantIndex
valueWitness ug getEnumTag
valueWitness up destructiveProjectEnumData
valueWitness ui destructiveInjectEnumTag
valueWitness et getEnumTagSinglePayload
valueWitness st storeEnumTagSinglePayload
""",
    ),
    "layouts": (
        "$s{b}yyxRlz{op}lF",
        "{q}<A where A: {text}>(A) -> ()",
        """
dependentGenericLayoutRequirement U _UnknownLayout
dependentGenericLayoutRequirement R _RefCountedObject
dependentGenericLayoutRequirement N _NativeRefCountedObject
dependentGenericLayoutRequirement C AnyObject
dependentGenericLayoutRequirement D _NativeClass
dependentGenericLayoutRequirement T _Trivial
dependentGenericLayoutRequirement E7_3_ _Trivial(8, 4)
dependentGenericLayoutRequirement e7_ _Trivial(8)
dependentGenericLayoutRequirement M7_3_ _TrivialAtMost(8, 4)
dependentGenericLayoutRequirement m7_ _TrivialAtMost(8)
""",
    ),
    "requirements": (
        "$s{b}yyx{op}lF",
        "{q}<A {text}>(A) -> ()",
        """
dependentGenericConformanceRequirement SHRz where A: Swift.Hashable
dependentGenericSameTypeRequirement SiRsz where A == Swift.Int
dependentGenericConformanceRequirement 4main1CCRbz where A: main.C
dependentGenericInverseConformanceRequirement Ri_z where A: ~Swift.Copyable
dependentGenericInverseConformanceRequirement Ri0_z where A: ~Swift.Escapable
dependentGenericSameTypeRequirement STRzSi7ElementRtz where A: Swift.Sequence, A.Element == Swift.Int
dependentGenericConformanceRequirement STRzSH7ElementRpz where A: Swift.Sequence, A.Element: Swift.Hashable
dependentGenericConformanceRequirement SHRzSERz where A: Swift.Hashable, A: Swift.Encodable
""",
    ),
    "metatypes": (
        "$s{b}VXM{op}D",
        "{text} {q}.Type",
        """
metatypeRepresentation t @thin
metatypeRepresentation T @thick
metatypeRepresentation o @objc_metatype
""",
    ),
    "local_names": (
        "$s{b}V1a{op}V",
        "{text}",
        """
localDeclName L_ a #1 in {q}
localDeclName L0_ a #2 in {q}
""",
    ),
    "differentiability": (
        "$s{b}VyYj{op}cD",
        "{text} () -> {q}",
        """
differentiableFunctionType d @differentiable
differentiableFunctionType f @differentiable(_forward)
differentiableFunctionType r @differentiable(reverse)
differentiableFunctionType l @differentiable(_linear)
""",
    ),
    "derivatives": (
        "$s{b}yyFTJ{op}SpSr",
        "{text} of {q}() -> () with respect to parameters {0} and results {0}",
        """
autoDiffFunctionKind f forward-mode derivative
autoDiffFunctionKind r reverse-mode derivative
autoDiffFunctionKind d differential
autoDiffFunctionKind p pullback
autoDiffFunctionKind Vf vtable thunk for forward-mode derivative
autoDiffFunctionKind Vr vtable thunk for reverse-mode derivative
""",
    ),
    "function_types": (
        "$s{b}Vy{op}D",
        "{text} () -> {q}",
        """
noEscapeFunctionType XE
escapingAutoClosureType XA @autoclosure
thinFunctionType Xf @convention(thin)
autoClosureType XK @autoclosure
uncurriedFunctionType XU
escapingObjCBlock XL @escaping @convention(block)
objCBlock XB @convention(block)
cFunctionPointer XC @convention(c)
isolatedAnyFunctionType YAc @isolated(any)
nonIsolatedCallerFunctionType YCc nonisolated(nonsending)
concurrentFunctionType Ybc @Sendable
differentiableFunctionType Yjrc @differentiable(reverse)
globalActorFunctionType ScMYcc @Swift.MainActor
clangType XzB3foo @convention(block, mangledCType: "foo")
""",
    ),
}

#: Other cases: kinds, symbol, text and, where it is not the symbol itself, what it encodes to. Fixed values of the format.
CASES = """
iVarInitializer | $s{b}Cfe | {q}.__ivar_initializer
initializer | $s{b}V1aSivpfi | variable initialization expression of {q}.a : Swift.Int
propertyWrapperBackingInitializer | $s{b}V1aSivpfP | property wrapper backing initializer of {q}.a : Swift.Int
propertyWrapperInitFromProjectedValue | $s{b}V1aSivpfW | property wrapper init from projected value of {q}.a : Swift.Int
propertyWrappedFieldInitAccessor | $s{b}V1aSivpfF | property wrapped field init accessor of {q}.a : Swift.Int
constructor | $s{b}CACycfc | {q}.init() -> {q}
typeAlias | $s{b}a | {q}
otherNominalType | $s{b}XY | {q}
protocolSelfConformanceDescriptor | $s{b}PMS | protocol self-conformance descriptor for {q} | $s{b}MS
extensionDescriptor | $s{b}V3ExtEMXE | extension descriptor (extension in Ext):{q}
moduleDescriptor | $s{m}MXM | module descriptor {r}
vTableThunk | $s{b}C1fyyFAA1DCADyyFTV | vtable thunk for {r}.D.f() -> () dispatching to {q}.f() -> ()
protocolWitness | $s{b}VSHAASH4hash4intoys6HasherVz_tFTW | protocol witness for Swift.Hashable.hash(into: inout Swift.Hasher) -> () in conformance {q} : Swift.Hashable in {r}
protocolSelfConformanceWitness | $s{b}P1fyyFTS | protocol self-conformance witness for {q}.f() -> ()
associatedTypeDescriptor dependentAssociatedTypeRef | $s1T{b}PTl | associated type descriptor for {q}.T
defaultAssociatedTypeMetadataAccessor | $s1T{b}PTM | default associated type metadata accessor for {q}.T
assocTypePath associatedConformanceDescriptor | $s{b}P1TAC_SHTn | associated conformance descriptor for {q}.{q}.T: Swift.Hashable
defaultAssociatedConformanceAccessor | $s{b}P1TAC_SHTN | default associated conformance accessor for {q}.{q}.T: Swift.Hashable
baseConformanceDescriptor | $s{b}PSHTb | base conformance descriptor for {q}: Swift.Hashable
enumCase | $s{b}O1ayA2CmFWC | enum case for {q}.a({q}.Type) -> {q}
protocolSelfConformanceWitnessTable | $s{b}PWS | protocol self-conformance witness table for {q} | $s{b}WS
lazyProtocolWitnessTableAccessor | $s{b}VACSHsWl | lazy protocol witness table accessor for type {q} and conformance {q} : Swift.Hashable in Swift
lazyProtocolWitnessTableCacheVariable | $s{b}VACSHsWL | lazy protocol witness table cache variable for type {q} and conformance {q} : Swift.Hashable in Swift
dynamicSelf | $s{b}CXDD | Self
sugaredOptional | $s{b}VXSqD | {q}?
sugaredDictionary | $s{b}VSSXSDD | [{q} : Swift.String]
sugaredParen | $s{b}VXSpD | ({q})
sugaredInlineArray | $s{b}VSiXSAD | [{q} of Swift.Int]
builtinFixedArray | $sSi{b}VBVD | Builtin.FixedArray<Swift.Int, {q}>
builtinBorrow | $s{b}VBWD | Builtin.Borrow<{q}>
outlinedEnumTagStore | $s{b}VWOi0_ | outlined enum tag store of {q}
outlinedEnumProjectDataForLoad | $s{b}VWOj0_ | outlined enum project data for load of {q}
genericSpecializationNotReAbstracted | $s{b}yyFSi_TG5 | generic not re-abstracted specialization <Swift.Int> of {q}() -> ()
genericSpecializationInResilienceDomain | $s{b}yyFSi_TB5 | generic specialization <Swift.Int> of {q}() -> ()
genericSpecializationPrespecialized | $s{b}yyFSi_Ts5 | generic pre-specialization <Swift.Int> of {q}() -> ()
inlinedGenericFunction | $s{b}yyFSi_Ti5 | inlined generic function <Swift.Int> of {q}() -> ()
genericPartialSpecialization | $s{b}yyFSiTp5 | generic partial specialization <Signature = Swift.Int> of {q}() -> ()
genericPartialSpecializationNotReAbstracted | $s{b}yyFSiTP5 | generic not-reabstracted partial specialization <Signature = Swift.Int> of {q}() -> ()
isSerialized | $s{b}yyFSi_Tgq5 | generic specialization <serialized, Swift.Int> of {q}() -> ()
asyncRemoved | $s{b}yyFSi_Tga5 | generic specialization <Swift.Int> of {q}() -> ()
functionSignatureSpecialization functionSignatureSpecializationParam functionSignatureSpecializationParamKind | $s{b}yyFTf4nnd_n | function signature specialization <Arg[2] = Dead> of {q}() -> ()
functionSignatureSpecializationReturn | $s{b}yyFTf4n_g | function signature specialization <Return = Owned To Guaranteed> of {q}() -> ()
droppedArgument | $s{b}yyFSi_Ttg5 | generic specialization <Swift.Int> of {q}() -> ()
keyPathGetterThunkHelper | $s{b}V1aSivpSiTK | key path getter for {q}.a : Swift.Int : Swift.Int
keyPathSetterThunkHelper | $s{b}V1aSivpSiTk | key path setter for {q}.a : Swift.Int : Swift.Int
keyPathAppliedMethodThunkHelper | $s{b}V1fyyFACTKMA | key path applied method {q}.f() -> () : {q} | $s{b}V1fyyFACTkMA
keyPathUnappliedMethodThunkHelper | $s{b}V1fyyFACTKmu | key path unapplied method {q}.f() -> () : {q} | $s{b}V1fyyFACTkmu
keyPathEqualsThunkHelper | $s{b}VSiTH | key path index equality operator for ({q}, Swift.Int)
keyPathHashThunkHelper | $s{b}VSiTh | key path index hash operator for ({q}, Swift.Int)
metatypeRepresentation | $s{b}VXMtD | @thin {q}.Type
existentialMetatype | $s{b}P_pXmTD | @thick {q}.Type | $s{b}_pXmTD
protocolListWithClass | $s{b}P_ACXcD | {q} & {q} | $s{b}_AaBPXcD
dependentGenericParamPackMarker | $s{b}yyxRvzlF | {q}<each A>(A) -> ()
dependentGenericParamValueMarker | $s{b}yyxRVzlF | {q}<let A: A>() -> ()
dependentGenericSameShapeRequirement | $s{b}yyx_q_tRhzr0_lF | {q}<A, B where A.shape == (A, B).shape>() -> ()
dependentGenericSameTypeRequirement | $s{b}yyxSiRszlF | {q}<A where A == Swift.Int>(A) -> ()
dependentGenericLayoutRequirement | $s{b}yyxRlzClF | {q}<A where A: AnyObject>(A) -> ()
dependentGenericInverseConformanceRequirement | $s{b}yyxRi_zlF | {q}<A where A: ~Swift.Copyable>(A) -> ()
opaqueReturnType opaqueReturnTypeOf opaqueReturnTypeParent | $s{b}QryFQOMQ | opaque type descriptor for <<opaque return type of {q}() -> some>>
opaqueType | $s{b}QryFQOyQo_D | <<opaque return type of {q}() -> some>>.0
prefixOperator | $s{b}V2eeopyyF | {q}.== prefix() -> ()
postfixOperator | $s{b}V2eeoPyyF | {q}.== postfix() -> ()
anonymousContext | $s{m}4AnonyXZ{n}V | {r}.(unknown context at Anon).{n}
protocolDescriptorRecord | $s{b}PHr | protocol descriptor runtime record for {q} | $s{b}Hr
protocolConformanceRefInProtocolModule | $s{b}VSHHpyHC | concrete protocol conformance {q} to protocol conformance ref (protocol's module) Swift.Hashable
protocolConformanceRefInOtherModule | $s{b}VSHAAyHC | concrete protocol conformance {q} to protocol conformance ref (retroactive) Swift.Hashable{r}
associatedTypeRef | $s{b}V1TQaD | {q}.T
associatedTypeGenericParamRef | $s{b}V1T_MXA | generic parameter reference for associated type {q}T
associatedTypeWitnessTableAccessor | $s{b}VSHs1T_SHWT | associated type witness table accessor for T : Swift.Hashable in {q} : Swift.Hashable in Swift
autoDiffDerivativeVTableThunk | $s{b}yyFTJVfSpSr | vtable thunk for forward-mode derivative of {q}() -> () with respect to parameters {0} and results {0}
autoDiffSelfReorderingReabstractionThunk | $s{b}VIegd_ACIegd_TJOf | autodiff self-reordering reabstraction thunk for forward-mode derivative from @escaping @callee_guaranteed () -> (@unowned {q}) to @escaping @callee_guaranteed () -> (@unowned {q})
autoDiffSubsetParametersThunk | $s{b}yyFTJSfSpSrSP | autodiff subset parameters thunk for forward-mode derivative from {q}() -> () with respect to parameters {0} and results {0} to parameters {0}
differentiabilityWitness | $s{b}yyFWJrSpSr | reverse-mode differentiability witness for {q}() -> () with respect to parameters {0} and results {0}
boundGenericClass | $s{b}CySiGD | {q}<Swift.Int>
boundGenericOtherNominalType | $s{b}XYySiGD | {q}<Swift.Int>
boundGenericProtocol | $s{b}PySiGD | {q}<Swift.Int>
boundGenericTypeAlias | $s{b}aySiGD | {q}<Swift.Int>
constrainedExistential constrainedExistentialRequirementList constrainedExistentialSelf dependentMemberType | $s{b}P_pSi1TRts_XPD | any {q}<Self.T == Swift.Int> | $s{b}_pSi1TRts_XPD
macro | $s{b}V1axfm | {q}.a : A
genericTypeParamDecl | $s{b}V1axfp | {q}.a
integer | $s{b}Vy$1_SiG | {q}<2, Swift.Int>
negativeInteger | $s{b}Vy$n3_SiGD | {q}<-4, Swift.Int>
outlinedBridgedMethod | $s{b}yyFTeab_ | outlined bridged method (ab) of {q}() -> ()
relatedEntityDeclName | $s{b}LeV | {r}.related decl 'e' for {n}
implDifferentiabilityKind | $s{b}VIrgd_D | @differentiable(reverse) @callee_guaranteed () -> (@unowned {q})
implErrorResult | $s{b}VSSIegozo_D | @escaping @callee_guaranteed () -> (@owned {q}, @error @owned Swift.String)
implFunctionAttribute implSendingResult | $s{b}VIegHTd_D | @escaping @callee_guaranteed @async () -> sending (@unowned {q})
implParameterSending | $s{b}VIegyT_D | @escaping @callee_guaranteed (@unowned sending {q}) -> ()
implParameterIsolated | $s{b}VIegyI_D | @escaping @callee_guaranteed (@unowned isolated {q}) -> ()
implParameterImplicitLeading | $s{b}VIegyL_D | @escaping @callee_guaranteed (@unowned sil_implicit_leading_param {q}) -> ()
reabstractionThunkHelper | $s{b}VIegd_ACIeyd_TR | reabstraction thunk helper from @escaping @callee_guaranteed () -> (@unowned {q}) to @escaping @callee_unowned () -> (@unowned {q})
reabstractionThunk | $s{b}VIegd_ACIeyd_Tr | reabstraction thunk from @escaping @callee_guaranteed () -> (@unowned {q}) to @escaping @callee_unowned () -> (@unowned {q})
reabstractionThunkHelperWithSelf | $s{b}VIegd_ACIeyd_ACTy | reabstraction thunk from @escaping @callee_guaranteed () -> (@unowned {q}) to @escaping @callee_unowned () -> (@unowned {q}) self {q}
implFunctionConvention implFunctionConventionName | $s{b}VIeyBy_D | @escaping @callee_unowned @convention(block) (@unowned {q}) -> ()
implCoroutineKind | $s{b}VIetMIy_D | @escaping @convention(thin) @convention(method) @yield_once_2 (@unowned {q}) -> ()
implYield | $s{b}VIegAYl_D | @escaping @callee_guaranteed @yield_once () -> (@yields @inout {q})
implErasedIsolation | $s{b}VIeAgYl_D | @escaping @isolated(any) @callee_guaranteed () -> (@yields @inout {q})
opaqueReturnTypeIndex | $s{b}QR_yF | {q}() -> some
packExpansion | $s{b}yyxxQp_tRvzlF | {q}<each A>(repeat A) -> ()
packElement packElementLevel | $s{b}yyxQe_RvzlF | {q}<each A>(/* level: 0 */ each A) -> ()
objCAsyncCompletionHandlerImpl | $s{b}VSiTz_ | @objc completion handler block implementation for {q} with result type Swift.Int
checkedObjCAsyncCompletionHandlerImpl | $s{b}VSiTZ0_ | predefined @objc completion handler block implementation for {q} with result type Swift.Int nonzero on error
functionSignatureSpecializationParamPayload | $s{b}yyFTf4pi12_n | function signature specialization <Arg[0] = [Constant Propagated Integer : 12]> of {q}() -> ()
dependentProtocolConformanceRoot | $s{b}VSHHD1_ | dependent root protocol conformance #0 {q} to Swift.Hashable
unknownIndex | $s{b}VSHHD0_ | dependent root protocol conformance {q} to Swift.Hashable
boundGenericFunction | $s{b}V1x1uACyxGx_qd__tclufc7MyaliasL_ayx_qd___GD | Myalias #1 in {q}<A>.<A1>(x: A, u: A1) -> {q}<A>
localDeclName | $s{b}V1TL_V | T #1 in {q}
macroExpansionUniqueName | $s{b}V3FoofMu_ | unique name #1 of Foo in {q}
macroExpansionLoc | $s{m}0023macro_expandswift_elFCffMX436_4_{n}fMf_ | freestanding macro expansion #1 of {n} in module {r} file macro_expand.swift line 437 column 5
globalVariableOnceDeclList globalVariableOnceFunction | $s{m}{n}_WZ | one-time initialization function for {n}
globalVariableOnceToken | $s{m}{n}_Wz | one-time initialization token for {n}
silBoxImmutableField silBoxLayout silBoxTypeWithLayout | $s{b}V_XxD | { let {q} }
silBoxMutableField | $s{b}Vz_XxD | { var {q} }
builtinTupleType | $s{b}VyBTcD | {q}(Builtin.TheTupleType) -> ()
builtinTypeName | $s{b}VyBpcD | {q}(Builtin.RawPointer) -> ()
errorType | $s{b}VyXecD | {q}(<ERROR TYPE>) -> ()
anyProtocolConformanceList concreteProtocolConformance protocolConformanceRefInTypeModule | $s{b}VSHHPyHC | concrete protocol conformance {q} to protocol conformance ref (type's module) Swift.Hashable
dependentPseudogenericSignature implPatternSubstitutions | $sxSo8_NSRangeVRlzCRl_Cr0_llySo{n}Cyxq_GIsPetWAlYl_TC | coroutine continuation prototype for @escaping @convention(thin) @convention(witness_method) @yield_once <A, B where A: AnyObject, B: AnyObject> @substituted <A> (@inout A) -> (@yields @inout __C._NSRange) for <__C.{n}<A, B>>
implInvocationSubstitutions | $sxRlzCly{b}CyxGIIegd_D | @escaping @callee_guaranteed <A where A: AnyObject> () -> (@unowned A) for <{q}<A>>
dependentProtocolConformanceOpaque retroactiveConformance | $s{m}1xAA3OfPVy3lib1GVyAA1fQryFQOyQo_GAjE1PAAxAeKHD1_AIHO_HCg_Gvp | {r}.x : {r}.OfP<lib.G<<<opaque return type of {r}.f() -> some>>.0>>
dependentAssociatedConformance dependentProtocolConformanceAssociated dependentProtocolConformanceInherited | $s3red4testyAA7OurTypeOy4them05TheirD0Vy5AssocQzGAjE0F8ProtocolAAxAA0c7DerivedH0HD1_AA0c4BaseH0HI1_AieKHA2__HCg_GxmAaLRzlF | red.test<A where A: red.OurDerivedProtocol>(A.Type) -> red.OurType<them.TheirType<A.Assoc>>
packProtocolConformance | $s23variadic_generic_opaque2G2VyAA2S1V_AA2S2VQPGAA1PHPAeA1QHPyHC_AgaJHPyHCHX_HC | concrete protocol conformance variadic_generic_opaque.G2<Pack{variadic_generic_opaque.S1, variadic_generic_opaque.S2}> to protocol conformance ref (type's module) variadic_generic_opaque.P with conditional requirements: (pack protocol conformance (concrete protocol conformance variadic_generic_opaque.S1 to protocol conformance ref (type's module) variadic_generic_opaque.Q, concrete protocol conformance variadic_generic_opaque.S2 to protocol conformance ref (type's module) variadic_generic_opaque.Q))
variadicMarker | $s{b}3arr1nySid_SStF | {q}(arr: Swift.Int..., n: Swift.String) -> ()
reabstractionThunkHelperWithGlobalActor | $s{b}VIegd_ACIegd_TRScMTU | reabstraction thunk helper from @escaping @callee_guaranteed () -> (@unowned {q}) to @escaping @callee_guaranteed () -> (@unowned {q}) with global actor constraint Swift.MainActor
emptyList | $sy |  empty-list 
firstElementMarker | $s_ |  first-element-marker 
"""

#: Symbols of the former grammar: kind, symbol, text and what it encodes to in the present one. Fixed values of the format.
FORMER = """
structure | _TtV{b} | {q} | $s{b}VD
class | _TtC{b} | {q} | $s{b}CD
enum | _TtO{b} | {q} | $s{b}OD
protocolList | _TtP{b}_ | {q} | $s{b}_pD
boundGenericStructure | _TtGSaV{b}_ | Swift.Array<{q}> | $sSay{b}VGD
boundGenericEnum | _TtGSqV{b}_ | Swift.Optional<{q}> | $s{b}VSgD
boundGenericStructure | _TtGVs10DictionarySSV{b}_ | Swift.Dictionary<Swift.String, {q}> | $sSDySS{b}VGD
tuple | _TtTV{b}Si_ | ({q}, Swift.Int) | $s{b}V_SitD
tuple | _TtT1aV{b}1bSi_ | (a: {q}, b: Swift.Int) | $s{b}V1a_Si1btD
functionType | _TtFV{b}Si | ({q}) -> Swift.Int | $sSi{b}VcD
uncurriedFunctionType | _TtfV{b}Si | ({q}) -> Swift.Int | $sSi{b}VXUD
functionType | _TtFT_V{b} | () -> {q} | $s{b}VycD
autoClosureType | _TtKT_V{b} | @autoclosure () -> {q} | $s{b}VyXKD
objCBlock | _TtbT_V{b} | @convention(block) () -> {q} | $s{b}VyXBD
cFunctionPointer | _TtcT_V{b} | @convention(c) () -> {q} | $s{b}VyXCD
functionType | _TtFzT_V{b} | () throws -> {q} | $s{b}VyKcD
metatype | _TtMV{b} | {q}.Type | $s{b}VmD
metatype | _TtXMtV{b} | @thick {q}.Type | $s{b}VXMTD
inOut | _TtRV{b} | inout {q} | $s{b}VzD
weak | _TtXwGSqC{b}_ | weak Swift.Optional<{q}> | $s{b}CSgXwD
unowned | _TtXoC{b} | unowned {q} | $s{b}CXoD
unmanaged | _TtXuC{b} | unowned(unsafe) {q} | $s{b}CXuD
dynamicSelf | _TtDC{b} | Self | $s{b}CXDD
builtinTypeName | _TtBi32_ | Builtin.Int32 | $sBi32_D
builtinTypeName | _TtBf64_ | Builtin.FPIEEE64 | $sBf64_D
builtinTypeName | _TtBo | Builtin.NativeObject | $sBoD
builtinTypeName | _TtBp | Builtin.RawPointer | $sBpD
builtinTypeName | _TtBw | Builtin.Word | $sBwD
builtinTypeName | _TtBv4Bi8_ | Builtin.Vec4xInt8 | $sBi8_Bv4_D
function | _TF{b}FT_T_ | {q}() -> () | $s{b}yyF
function | _TF{b}FTSi1aSS_T_ | {q}(Swift.Int, a: Swift.String) -> () | $s{b}ySi_SS1atF
function | _TF{b}FzT_T_ | {q}() throws -> () | $s{b}yyKF
function | _TF{b}urFxT_ | {q}<A>(A) -> () | $s{b}yxlF
function | _TF{b}uRxs8HashablerFxT_ | {q}<A where A: Swift.Hashable>(A) -> () | $s{b}yxSHRzlF
function | _TFV{b}3foofT_T_ | {q}.foo() -> () | $s{b}V3fooyyF
function | _TFC{b}3foofT_T_ | {q}.foo() -> () | $s{b}C3fooyyF
static | _TZFC{b}3foofT_T_ | static {q}.foo() -> () | $s{b}C3fooyyFZ
constructor | _TFC{b}cfT_S0_ | {q}.init() -> {q} | $s{b}CACyXUfc
allocator | _TFC{b}CfT_S0_ | {q}.__allocating_init() -> {q} | $s{b}CACyXUfC
deallocator | _TFC{b}D | {q}.__deallocating_deinit | $s{b}CfD
destructor | _TFC{b}d | {q}.deinit | $s{b}Cfd
iVarDestroyer | _TFC{b}E | {q}.__ivar_destroyer | $s{b}CfE
iVarInitializer | _TFC{b}e | {q}.__ivar_initializer | $s{b}Cfe
getter | _TFC{b}g1aSi | {q}.a.getter : Swift.Int | $s{b}C1aSivg
setter | _TFC{b}s1aSi | {q}.a.setter : Swift.Int | $s{b}C1aSivs
materializeForSet | _TFC{b}m1aSi | {q}.a.materializeForSet : Swift.Int | $s{b}C1aSivm
willSet | _TFC{b}w1aSi | {q}.a.willset : Swift.Int | $s{b}C1aSivw
didSet | _TFC{b}W1aSi | {q}.a.didset : Swift.Int | $s{b}C1aSivW
unsafeMutableAddressor | _TFC{b}au1aSi | {q}.a.unsafeMutableAddressor : Swift.Int | $s{b}C1aSivau
unsafeAddressor | _TFC{b}lu1aSi | {q}.a.unsafeAddressor : Swift.Int | $s{b}C1aSivlu
nativeOwningMutableAddressor | _TFC{b}ao1aSi | {q}.a.nativeOwningMutableAddressor : Swift.Int | $s{b}C1aSivao
nativeOwningAddressor | _TFC{b}lo1aSi | {q}.a.nativeOwningAddressor : Swift.Int | $s{b}C1aSivlo
owningMutableAddressor | _TFC{b}aO1aSi | {q}.a.owningMutableAddressor : Swift.Int | $s{b}C1aSivaO
owningAddressor | _TFC{b}lO1aSi | {q}.a.owningAddressor : Swift.Int | $s{b}C1aSivlO
nativePinningMutableAddressor | _TFC{b}ap1aSi | {q}.a.nativePinningMutableAddressor : Swift.Int | $s{b}C1aSivaP
nativePinningAddressor | _TFC{b}lp1aSi | {q}.a.nativePinningAddressor : Swift.Int | $s{b}C1aSivlp
variable | _TvC{b}1aSi | {q}.a : Swift.Int | $s{b}C1aSivp
initializer | _TIvC{b}1aSii | variable initialization expression of {q}.a : Swift.Int | $s{b}C1aSivpfi
defaultArgumentInitializer | _TIF{b}FT1aSi_T_A_ | default argument 0 of {q}(a: Swift.Int) -> () | $s{b}ySi1a_tFfA_
explicitClosure | _TFF{b}FT_T_U_FT_T_ | closure #1 () -> () in {q}() -> () | $s{b}yyFyycfU_
implicitClosure | _TFF{b}FT_T_u_FT_T_ | implicit closure #1 () -> () in {q}() -> () | $s{b}yyFyycfu_
function | _TFF{b}FT_T_L_3barFT_T_ | bar #1 () -> () in {q}() -> () | $s{b}yyF3barL_yyF
function | _TF{m}P10_1234567893fooFT_T_ | {r}.(foo in _123456789)() -> () | $s{m}3foo10_123456789LLyyF
function | _TF{m}oi2eeFTSiSi_Sb | {r}.== infix(Swift.Int, Swift.Int) -> Swift.Bool | $s{m}2eeoiSbSi_SitF
function | _TF{m}op2eeFSiSb | {r}.== prefix(Swift.Int) -> Swift.Bool | $s{m}2eeopSbSiF
function | _TF{m}oP2eeFSiSb | {r}.== postfix(Swift.Int) -> Swift.Bool | $s{m}2eeoPSbSiF
typeMetadata | _TMV{b} | type metadata for {q} | $s{b}VN
fullTypeMetadata | _TMfV{b} | full type metadata for {q} | $s{b}VMf
typeMetadataAccessFunction | _TMaV{b} | type metadata accessor for {q} | $s{b}VMa
nominalTypeDescriptor | _TMnV{b} | nominal type descriptor for {q} | $s{b}VMn
metaclass | _TMmC{b} | metaclass for {q} | $s{b}CMm
typeMetadataLazyCache | _TMLV{b} | lazy cache variable for type metadata for {q} | $s{b}VML
genericTypeMetadataPattern | _TMPV{b} | generic type metadata pattern for {q} | $s{b}VMP
valueWitnessTable | _TWVV{b} | value witness table for {q} | $s{b}VWV
fieldOffset | _TWvdvC{b}1aSi | direct field offset for {q}.a : Swift.Int | $s{b}C1aSivpWvd
fieldOffset | _TWvivC{b}1aSi | indirect field offset for {q}.a : Swift.Int | $s{b}C1aSivpWvi
protocolWitnessTable | _TWPV{b}s8Hashable{m} | protocol witness table for {q} : Swift.Hashable in {r} | $s{b}VSHAAWP
protocolWitnessTableAccessor | _TWaV{b}s8Hashable{m} | protocol witness table accessor for {q} : Swift.Hashable in {r} | $s{b}VSHAAWa
valueWitness | _TwalV{b} | allocateBuffer value witness for {q} | $s{b}Vwal
valueWitness | _TwtaV{b} | assignWithTake value witness for {q} | $s{b}Vwta
valueWitness | _TwdeV{b} | deallocateBuffer value witness for {q} | $s{b}Vwde
valueWitness | _TwxxV{b} | destroy value witness for {q} | $s{b}Vwxx
valueWitness | _TwXXV{b} | destroyBuffer value witness for {q} | $s{b}VwXX
valueWitness | _TwCPV{b} | initializeBufferWithCopyOfBuffer value witness for {q} | $s{b}VwCP
valueWitness | _TwCpV{b} | initializeBufferWithCopy value witness for {q} | $s{b}VwCp
valueWitness | _TwcpV{b} | initializeWithCopy value witness for {q} | $s{b}Vwcp
valueWitness | _TwTkV{b} | initializeBufferWithTake value witness for {q} | $s{b}VwTk
valueWitness | _TwtkV{b} | initializeWithTake value witness for {q} | $s{b}Vwtk
valueWitness | _TwprV{b} | projectBuffer value witness for {q} | $s{b}Vwpr
valueWitness | _TwTKV{b} | initializeBufferWithTakeOfBuffer value witness for {q} | $s{b}VwTK
valueWitness | _TwCcV{b} | initializeArrayWithCopy value witness for {q} | $s{b}VwCc
valueWitness | _TwTtV{b} | initializeArrayWithTakeFrontToBack value witness for {q} | $s{b}VwTt
valueWitness | _TwtTV{b} | initializeArrayWithTakeBackToFront value witness for {q} | $s{b}VwtT
valueWitness | _TwxsV{b} | storeExtraInhabitant value witness for {q} | $s{b}Vwxs
valueWitness | _TwxgV{b} | getExtraInhabitantIndex value witness for {q} | $s{b}Vwxg
valueWitness | _TwugV{b} | getEnumTag value witness for {q} | $s{b}Vwug
valueWitness | _TwupV{b} | destructiveProjectEnumData value witness for {q} | $s{b}Vwup
objCAttribute | _TToFC{b}3foofT_T_ | @objc {q}.foo() -> () | $s{b}C3fooyyFTo
nonObjCAttribute | _TTOF{b}FT_T_ | @nonobjc {q}() -> () | $s{b}yyFTO
directMethodReferenceAttribute | _TTdFC{b}3foofT_T_ | super {q}.foo() -> () | $s{b}C3fooyyFTd
dynamicAttribute | _TTDFC{b}3foofT_T_ | dynamic {q}.foo() -> () | $s{b}C3fooyyFTD
genericSpecialization | _TTSg5Si___TF{b}FT_T_ | generic specialization <Swift.Int> of {q}() -> () | $s{b}yyFSi_Tg5
genericSpecialization | _TTSgq5Si___TF{b}FT_T_ | generic specialization <serialized, Swift.Int> of {q}() -> () | $s{b}yyFSi_Tgq5
genericSpecializationNotReAbstracted | _TTSr5Si___TF{b}FT_T_ | generic not re-abstracted specialization <Swift.Int> of {q}() -> () | $s{b}yyFSi_TG5
functionSignatureSpecialization | _TTSf1n___TF{b}FT_T_ | function signature specialization <> of {q}() -> () | $s{b}yyFTf1n_n
functionSignatureSpecialization | _TTSf1d___TF{b}FT_T_ | function signature specialization <Arg[0] = Dead> of {q}() -> () | $s{b}yyFTf1d_n
functionSignatureSpecialization | _TTSf1g___TF{b}FT_T_ | function signature specialization <Arg[0] = Owned To Guaranteed> of {q}() -> () | $s{b}yyFTf1g_n
functionSignatureSpecialization | _TTSf1o___TF{b}FT_T_ | function signature specialization <Arg[0] = Guaranteed To Owned> of {q}() -> () | $s{b}yyFTf1o_n
functionSignatureSpecialization | _TTSf1s___TF{b}FT_T_ | function signature specialization <Arg[0] = Exploded> of {q}() -> () | $s{b}yyFTf1x_n
functionSignatureSpecialization | _TTSf1i___TF{b}FT_T_ | function signature specialization <Arg[0] = Value Promoted from Box> of {q}() -> () | $s{b}yyFTf1i_n
functionSignatureSpecialization | _TTSf1dg___TF{b}FT_T_ | function signature specialization <Arg[0] = Dead and Owned To Guaranteed> of {q}() -> () | $s{b}yyFTf1dG_n
functionSignatureSpecialization | _TTSf1cpi12___TF{b}FT_T_ | function signature specialization <Arg[0] = [Constant Propagated Integer : 12]> of {q}() -> () | $s{b}yyFTf1pi12_n
functionSignatureSpecialization | _TTSf1cpfl12___TF{b}FT_T_ | function signature specialization <Arg[0] = [Constant Propagated Float : 12]> of {q}() -> () | $s{b}yyFTf1pd12_n
function | _TFE3ExtV{b}3foofT_T_ | (extension in Ext):{q}.foo() -> () | $s{b}V3ExtE3fooyyF
implFunctionType | _TtXFo_oV{b}_dSi_ | @callee_owned (@owned {q}) -> (@unowned Swift.Int) | $s{b}VSiIxxd_D
implFunctionType | _TtXFo__dV{b}_ | @callee_owned () -> (@unowned {q}) | $s{b}VIxd_D
"""


def _families() -> dict[str, list[tuple[str, str, str, str]]]:
    """(kind, symbol, text, encoded) per family."""
    out: dict[str, list[tuple[str, str, str, str]]] = {}
    for name, (symbol, text, lines) in FAMILIES.items():
        for line in lines.strip().splitlines():
            kind, op, *words = line.split(" ", 2)
            mangled = symbol.replace("{op}", op)
            out.setdefault(name, []).append((kind, mangled, text.replace("{text}", words[0] if words else "").removeprefix(" "), mangled))
    for name, lines in (("forms", CASES), ("former_grammar", FORMER)):
        for line in lines.strip("\n").splitlines():
            kinds, symbol, text, *encoded = line.split(" | ")
            out.setdefault(name, []).extend((kind, symbol, text, encoded[0] if encoded else symbol) for kind in kinds.split())
    return out


#: Symbols of types, the type as text (generic parameters by depth and index, modules left out) and the callback of a builder that makes it.
TYPES = """
$s{b}VD | {n} | nominal
$s{b}CD | {n} | nominal
$s{b}OD | {n} | nominal
$s{b}XYD | {n} | nominal
$s{b}aD | {n} | alias
$s{b}V1TVD | {n}.T | nominal
$s{b}V3ExtE1TVD | {n}.T | nominal
$s{b}VySiGD | {n}<Int> | bound
$s{b}V1TVySi_SSGD | {n}<Int>.T<String> | bound
$sSo{n}CD | {n} | objc_class
$sSo{n}CySiGD | {n}<Int> | objc_class
$sSo{n}PD | any {n} | protocols
$s{b}PD | any {n} | protocols
$s{b}P_pD | any {n} | protocols
$s{b}P_SHpD | any {n} & Hashable | protocols
$s{b}P_{b}CXcD | any {n} & {n} | protocols
$s{b}P_XlD | any {n} & AnyObject | protocols
$s{b}P_pSi1TRts_XPD | any {n}<τ_0_0.T == Int> | constrained
$sBpD | RawPointer | builtin
$sBi32_D | Int32 | builtin
$s$1_{b}VBVD | Builtin.FixedArray<2, {n}> | fixed_array
$s{b}VmD | {n}.Type | metatype
$s{b}VXMtD | @thin {n}.Type | metatype
$s{b}P_pXpD | any {n}.Type | existential_metatype
$s{b}P_pXmTD | @thick any {n}.Type | existential_metatype
$s{b}CXDD | Self | dynamic_self
$sSi_{b}VtD | (Int, {n}) | tuple
$s{b}V_QPD | Pack{{n}} | pack
$s{b}VyxxQp_QPGD | {n}<Pack{repeat τ_0_0}> | bound
$sxxQp_{b}VQPD | Pack{repeat τ_0_0, {n}} | pack
$s{b}VXwD | @sil_weak {n} | storage
$s{b}CXoD | @sil_unowned {n} | storage
$s{b}CXuD | @sil_unmanaged {n} | storage
$s{b}VXbD | @box {n} | box
$s{b}V_XxD | @box{let {n}} | box_layout
$s{b}Vz_XxD | @box{var {n}} | box_layout
$sxz_{b}V_RlzClXXD | @box{var τ_0_0}<τ_0_0 = {n}> where τ_0_0: Class | box_layout
$s{b}VXSqD | {n}? | sugar
$s{b}VXSaD | [{n}] | sugar
$sSS{b}VXSDD | [String : {n}] | sugar
$s$1_{b}VXSAD | [2 of {n}] | sugar
$s{b}VXSpD | {n} | nominal
$s{b}Vy$1_SiGD | {n}<2, Int> | bound
$s{b}Vy$n3_SiGD | {n}<-4, Int> | bound
$s{b}VycD | () -> {n} | function
$sySi_{b}VtcD | (Int, {n}) -> () | function
$sySiz_{b}VntcD | (inout Int, __owned {n}) -> () | function
$sySih_{b}VYutcD | (__shared Int, sending {n}) -> () | function
$sySi_{b}VYktcD | (Int, @noDerivative {n}) -> () | function
$sySid_tcD | (Int...) -> () | function
$s{b}VyYaKcD | () async throws -> {n} | function
$s{b}VySSYKcD | () throws(String) -> {n} | function
$s{b}VyYbXED | @Sendable () -> {n} | function
$s{b}VyYAcD | @isolated(any) () -> {n} | function
$s{b}VyYCcD | nonisolated(nonsending) () -> {n} | function
$s{b}VyYTcD | () -> sending {n} | function
$s{b}VyYjrcD | @differentiable(reverse) () -> {n} | function
$s{b}VyScMYccD | @MainActor () -> {n} | function
$s{b}VyXCD | @convention(c) () -> {n} | function
$s{b}VyXBD | @convention(block) () -> {n} | function
$s{b}VyXfD | @convention(thin) () -> {n} | function
$s{b}VIegd_D | @escaping @callee_guaranteed () -> @unowned {n} | impl_function
$s{b}VIegHyT_D | @escaping @async @callee_guaranteed (@unowned sending {n}) -> () | impl_function
$s{b}VIegAYl_D | @escaping @yield_once @callee_guaranteed () -> @yields @inout {n} | impl_function
$s{b}VSSIegozo_D | @escaping @callee_guaranteed () -> (@owned {n}, @error @owned String) | impl_function
$s{b}VIeyBy_D | @escaping @convention(block) @callee_unowned (@unowned {n}) -> () | impl_function
$s{b}VIetMAy_D | @escaping @convention(method) @yield_once @convention(thin) (@unowned {n}) -> () | impl_function
$s{b}VIeAgd_D | @escaping @isolated(any) @callee_guaranteed () -> @unowned {n} | impl_function
$s{b}VIrgd_D | @differentiable(reverse) @callee_guaranteed () -> @unowned {n} | impl_function
$s1TSTQzD | (τ_0_0 as Sequence).T | member
$s{b}QryFQOyQo_D | some <opaque> | opaque
$sxD | τ_0_0 | param
$sx_q_tD | (τ_0_0, τ_0_1) | tuple
$sSi1a_{b}V1btD | (a: Int, b: {n}) | tuple
$sxz_{b}V_SHRzRi_zlXXD | @box{var τ_0_0}<τ_0_0 = {n}> where τ_0_0: Hashable, τ_0_0: ~Copyable | box_layout
$sxz_{b}V_RlzE7_3_lXXD | @box{var τ_0_0}<τ_0_0 = {n}> where τ_0_0: TrivialOfExactSize(8, 4) | box_layout
$sxz_{b}V_Rlze7_lXXD | @box{var τ_0_0}<τ_0_0 = {n}> where τ_0_0: TrivialOfExactSize(8, 0) | box_layout
$sxz_{b}V_SiRszlXXD | @box{var τ_0_0}<τ_0_0 = {n}> where τ_0_0 == Int | box_layout
$sxz_{b}V_{b}CRbzlXXD | @box{var τ_0_0}<τ_0_0 = {n}> where τ_0_0: {n} | box_layout
$sx_q_z{b}V_Sir0_lXXD | @box{let τ_0_0, var τ_0_1}<τ_0_0 = {n}, τ_0_1 = Int> | box_layout
$sSi{b}VIegyd_D | @escaping @callee_guaranteed (@unowned Int) -> @unowned {n} | impl_function
"""


#: A name that is no identifier, as it is encoded.
SPACED = {"MIDDLE EAST": "0016MIDDLEEAST_AxJAc", "SAUDI ARABIA": "0017SAUDIARABIA_EzEFc", "UNITED KINGDOM": "0019UNITEDKINGDOM_gEEEd", "UNITED STATES": "0018UNITEDSTATES_bCJJc"}


def _filled(template: Column, **parts: Column) -> Column:
    for name, value in parts.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "r_name", "n_name")


def _symbols(names: DataFrame, table: Column) -> DataFrame:
    """n_nationkey, case (a struct of `table`, which has a form) and symbol."""
    mangled = lambda name: F.concat(F.length(name).cast("string"), name)
    m, n = mangled(F.col("r_name")), mangled(F.col("n_name"))
    each = names.select("*", F.explode(table).alias("case"))
    return each.select("n_nationkey", "case", _filled(F.col("case.form"), b=F.concat(m, n), m=m, n=n).alias("symbol"))


def _query(cases: list[tuple[str, str, str, str]]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("form")) for k, s, *_ in cases])
        rows = _symbols(_names(spark, sf_dir), table).select("n_nationkey", "case.kind", "symbol")
        parsed = rows.withColumn("parsed", S.demangle(F.col("symbol"))).select("n_nationkey", "kind", "symbol", F.col("parsed.tree").alias("nodes"))
        reached = F.exists("nodes", lambda x: x["kind"] == F.col("kind"))
        return parsed.select("n_nationkey", "kind", "symbol", reached.alias("reached"), S.print_symbol(F.col("symbol")).alias("printed"), S.remangle(F.col("symbol")).alias("encoded"))

    return run


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill(template: str, **parts: str) -> str:
    for name, value in parts.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in rows)


def _encoded(name: str) -> str:
    return f"CASE {name} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in SPACED.items()) + f" ELSE length({name}) || {name} END"


NAMES = f"t AS (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, r_name, n_name, length(r_name) || r_name AS m, length(n_name) || n_name AS n, {_encoded('r_name')} AS em, {_encoded('n_name')} AS en FROM region JOIN nation ON r_regionkey = n_regionkey)"


def _sql(cases: list[tuple[str, str, str, str]]) -> str:
    symbol, printed = _fill("form", b="m || n", m="m", n="n"), _fill("text", q="r_name || '.' || n_name", r="r_name", n="n_name")
    return f"WITH c(kind, form, text, again) AS (VALUES {_values(cases)}), {NAMES} SELECT n_nationkey, kind, {symbol} AS symbol, TRUE AS reached, {printed} AS printed, '_' || {_fill('again', b='em || en', m='em', n='en')} AS encoded FROM t, c"


_TYPES = [tuple(line.split(" | ")) for line in TYPES.strip().splitlines()]


def dispatch_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every callback of the type builder that makes a type."""
    rows = _symbols(_names(spark, sf_dir), F.array(*[F.struct(F.lit(form).alias("form")) for form, *_ in _TYPES]))
    json = F.parse_json(S.decode_type_json(F.col("symbol")))
    return rows.select("n_nationkey", "symbol", S.decode_type(F.col("symbol")).alias("type"), F.variant_get(json, "$.type", "string").alias("callback"))


#: Kinds that only a resolver of symbolic references makes: the kind, a type of such a reference (its byte as in the symbol) and the type's text.
REFERENCES = [
    ("typeSymbolicReference", "\x01", "type symbolic reference 0x1000"),
    ("protocolSymbolicReference", "\x02_p", "protocol symbolic reference 0x1000"),
    ("objectiveCProtocolSymbolicReference", "\x0c_p", "objective-c protocol symbolic reference 0x1000"),
    ("uniqueExtendedExistentialTypeShapeSymbolicReference", "\x0aSiXj", "symbolic existential type (unique) 0x1000 <Swift.Int>"),
    ("nonUniqueExtendedExistentialTypeShapeSymbolicReference", "\x0bSiXj", "symbolic existential type (non-unique) 0x1000 <Swift.Int>"),
    ("symbolicExtendedExistentialType", "\x0bSSXj", "symbolic existential type (non-unique) 0x1000 <Swift.String>"),
]


def _resolve(kind: str, way: str, number: int) -> Tree:
    if kind == "context":
        return Tree("type", (Tree("typeSymbolicReference" if way == "direct" else "protocolSymbolicReference", index=4096),))
    node = Tree(kind if kind == "accessorFunctionReference" else kind + "SymbolicReference", index=4096)
    return Tree("type", (node,)) if kind == "objectiveCProtocol" else node


def _resolve_opaque(kind: str, way: str, number: int) -> Tree:
    return Tree("opaqueTypeDescriptorSymbolicReference", index=4096)


def dispatch_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(f"$s{of}_{{b}}VtD").alias("form")) for kind, of, _ in REFERENCES])
    others = [("accessorFunctionReference", "$s\x09", _resolve), ("opaqueTypeDescriptorSymbolicReference", "$s\x01yQo_D", _resolve_opaque)]
    names = _names(spark, sf_dir)
    out = None
    for cases, resolver in ((_symbols(names, table).select("n_nationkey", "case.kind", "symbol"), _resolve), *((names.select("n_nationkey", F.lit(kind).alias("kind"), F.lit(symbol).alias("symbol")), resolver) for kind, symbol, resolver in others)):
        parsed = cases.select("n_nationkey", "kind", S.demangle(F.col("symbol"), resolver=resolver).alias("parsed")).select("n_nationkey", "kind", F.col("parsed.tree").alias("nodes"))
        rows = parsed.select("n_nationkey", "kind", F.exists("nodes", lambda x: x["kind"] == F.col("kind")).alias("reached"), S.print_tree(F.col("nodes")).alias("printed"))
        out = rows if out is None else out.unionAll(rows)
    return out


_CASES = _families()
QUERIES = {f"dispatch_{name}": _query(cases) for name, cases in _CASES.items()} | {"dispatch_types": dispatch_types, "dispatch_references": dispatch_references}
ORACLES = {f"dispatch_{name}": _sql(cases) for name, cases in _CASES.items()} | {
    "dispatch_types": f"WITH c(form, type, callback) AS (VALUES {_values(_TYPES)}), {NAMES} SELECT n_nationkey, {_fill('form', b='m || n', m='m', n='n')} AS symbol, {_fill('type', n='n_name')} AS type, callback FROM t, c",
    "dispatch_references": f"WITH c(kind, text) AS (VALUES {_values([(k, '(' + text + ', {q})') for k, _, text in REFERENCES] + [('accessorFunctionReference', 'accessor function at 4096'), ('opaqueTypeDescriptorSymbolicReference', 'opaque type symbolic reference 0x1000.0')])}), {NAMES} SELECT n_nationkey, kind, TRUE AS reached, {_fill('text', q="r_name || '.' || n_name")} AS printed FROM t, c",
}
