"""The mangling grammar as data.

A regular operator pops operands, last pushed first, and makes one node whose children stand in the order in which they were
pushed. Operand letters: t type, c the child of a type, g the child of a type that must be a nominal, e entity, p protocol, f protocol conformance, n declaration name, a anything,
x context, m module, i identifier, P associated type path, N associated type name, l protocol list, k index name read after the operator.
A capital W in front wraps the node in `type`.
"""

from __future__ import annotations

REGULAR = """
D typeMangling t | N typeMetadata t | Z static e | h W.shared c | z W.inOut c | n W.owned c | m W.metatype t
HP protocolConformanceRefInTypeModule p | Hp protocolConformanceRefInProtocolModule p | Hc protocolConformanceDescriptorRecord f
Hn nominalTypeDescriptorRecord t | Ho opaqueTypeDescriptorRecord a | Hr protocolDescriptorRecord p
Yc globalActorFunctionType c | Yi W.isolated c | Yk W.noDerivative c | YK typedThrowsAnnotation c | Yt W.compileTimeLiteral c
Yu W.sending c | Yg W.constValue c
BV W.builtinFixedArray tt | BW W.builtinBorrow t
Ma typeMetadataAccessFunction t | MA reflectionMetadataAssocTypeDescriptor f | Mb canonicalSpecializedGenericTypeMetadataAccessFunction t
MB reflectionMetadataBuiltinDescriptor t | MC reflectionMetadataSuperclassDescriptor g | Mc protocolConformanceDescriptor f | MD typeMetadataDemanglingCache t | Md typeMetadataDemanglingCache t
MR typeMetadataMangledNameRef t | Mf fullTypeMetadata t | MF reflectionMetadataFieldDescriptor t | Mg opaqueTypeDescriptorAccessor a
Mh opaqueTypeDescriptorAccessorImpl a | Mi typeMetadataInstantiationFunction t | MI typeMetadataInstantiationCache t
Mj opaqueTypeDescriptorAccessorKey a | MJ noncanonicalSpecializedGenericTypeMetadataCache a | Mk opaqueTypeDescriptorAccessorVar a
MK metadataInstantiationCache a | Ml typeMetadataSingletonInitializationCache t | ML typeMetadataLazyCache t | Mm metaclass t
MM canonicalSpecializedGenericMetaclass t | Mn nominalTypeDescriptor t | MN noncanonicalSpecializedGenericTypeMetadata t
Mo classMetadataBaseOffset t | Mp protocolDescriptor p | MP genericTypeMetadataPattern t | Mq uniquable a | MQ opaqueTypeDescriptor a
Mr typeMetadataCompletionFunction t | Ms objCResilientClassStub t | MS protocolSelfConformanceDescriptor p | Mt fullObjCResilientClassStub t
Mu methodLookupFunction t | MU objCMetadataUpdateFunction t | MV propertyDescriptor e | Mz canonicalPrespecializedGenericTypeCachingOnceToken t
MXE extensionDescriptor x | MXM moduleDescriptor m | MXX anonymousDescriptor x | MXY anonymousDescriptor ax | MXA associatedTypeGenericParamRef Pt
QO opaqueReturnTypeOf x
TTI silThunkIdentity e | Tc curryThunk e | Tj dispatchThunk e | Tq methodDescriptor e | TC coroutineContinuationPrototype t
TV vTableThunk ee | TW protocolWitness ef | TS protocolSelfConformanceWitness e | Tl associatedTypeDescriptor N
TL protocolRequirementsBaseDescriptor p | TM defaultAssociatedTypeMetadataAccessor N | Tn associatedConformanceDescriptor pPt
TN defaultAssociatedConformanceAccessor pPt | Tb baseConformanceDescriptor pt | TU reabstractionThunkHelperWithGlobalActor ta
TY asyncSuspendResumePartialFunction k | TQ asyncAwaitResumePartialFunction k
WC enumCase e | WV valueWitnessTable t | WS protocolSelfConformanceWitnessTable p | WP protocolWitnessTable f | Wp protocolWitnessTablePattern f
WG genericProtocolWitnessTable f | WI genericProtocolWitnessTableInstantiationFunction f | Wr resilientProtocolWitnessTable f
Wl lazyProtocolWitnessTableAccessor ft | WL lazyProtocolWitnessTableCacheVariable ft | Wa protocolWitnessTableAccessor f
Wt associatedTypeMetadataAccessor nf | WT associatedTypeWitnessTableAccessor tPf | Wb baseWitnessTableAccessor tf
Xo W.unowned t | Xu W.unmanaged t | Xw W.weak t | Xb W.silBoxType t | XD W.dynamicSelf t | Xp W.existentialMetatype t
Xl W.protocolListWithAnyObject l | XSq W.sugaredOptional t | XSa W.sugaredArray t | XSD W.sugaredDictionary tt | XSp W.sugaredParen t
XSA W.sugaredInlineArray tt
"""

LEAVES = """
HF accessibleFunctionRecord | K throwsAnnotation | d variadicMarker | y emptyList | _ firstElementMarker
Ya asyncAnnotation | YA isolatedAnyFunctionType | Yb concurrentFunctionType | YC nonIsolatedCallerFunctionType | YT sendingResultFunctionType
To objCAttribute | TO nonObjCAttribute | TD dynamicAttribute | Td directMethodReferenceAttribute | TE distributedThunk | TF distributedAccessor
Ta partialApplyObjCForwarder | TA partialApplyForwarder | Tm mergedFunction | TX dynamicallyReplaceableFunctionVar
Tx dynamicallyReplaceableFunctionKey | TI dynamicallyReplaceableFunctionImpl | Tu asyncFunctionPointer | Twb backDeploymentThunk
TwB backDeploymentFallback | Twc coroFunctionPointer | Twd defaultOverride | TwS hasSymbolQuery
"""

#: Function types by operator.
FUNCTIONS = {"c": "functionType", "XE": "noEscapeFunctionType", "XA": "escapingAutoClosureType", "Xf": "thinFunctionType", "XK": "autoClosureType", "XU": "uncurriedFunctionType", "XL": "escapingObjCBlock", "XB": "objCBlock", "XC": "cFunctionPointer", "XzB": "objCBlock", "XzC": "cFunctionPointer"}
NOMINALS = {"C": "class", "O": "enum", "P": "protocol", "V": "structure", "a": "typeAlias", "XY": "otherNominalType"}
ACCESSORS = {"m": "materializeForSet", "s": "setter", "g": "getter", "G": "globalGetter", "w": "willSet", "W": "didSet", "r": "readAccessor", "y": "read2Accessor", "M": "modifyAccessor", "x": "modify2Accessor", "i": "initAccessor", "b": "borrowAccessor", "z": "mutateAccessor", "aO": "owningMutableAddressor", "ao": "nativeOwningMutableAddressor", "aP": "nativePinningMutableAddressor", "au": "unsafeMutableAddressor", "lO": "owningAddressor", "lo": "nativeOwningAddressor", "lp": "nativePinningAddressor", "lu": "unsafeAddressor"}
#: Function entities: kind and what they take besides the context.
ENTITIES = {"D": ("deallocator", ""), "d": ("destructor", ""), "Z": ("isolatedDeallocator", ""), "E": ("iVarDestroyer", ""), "e": ("iVarInitializer", ""), "i": ("initializer", ""), "C": ("allocator", "type"), "c": ("constructor", "type"), "U": ("explicitClosure", "closure"), "u": ("implicitClosure", "closure"), "A": ("defaultArgumentInitializer", "index"), "P": ("propertyWrapperBackingInitializer", ""), "W": ("propertyWrapperInitFromProjectedValue", ""), "F": ("propertyWrappedFieldInitAccessor", "")}
MACROS = {"a": "accessorAttachedMacroExpansion", "r": "memberAttributeAttachedMacroExpansion", "m": "memberAttachedMacroExpansion", "p": "peerAttachedMacroExpansion", "c": "conformanceAttachedMacroExpansion", "e": "extensionAttachedMacroExpansion", "q": "preambleAttachedMacroExpansion", "b": "bodyAttachedMacroExpansion", "f": "freestandingMacroExpansion", "u": "macroExpansionUniqueName"}
OUTLINED = {"B": "outlinedInitializeWithTakeNoValueWitness", "C": "outlinedInitializeWithCopyNoValueWitness", "D": "outlinedAssignWithTakeNoValueWitness", "F": "outlinedAssignWithCopyNoValueWitness", "H": "outlinedDestroyNoValueWitness", "y": "outlinedCopy", "e": "outlinedConsume", "r": "outlinedRetain", "s": "outlinedRelease", "b": "outlinedInitializeWithTake", "c": "outlinedInitializeWithCopy", "d": "outlinedAssignWithTake", "f": "outlinedAssignWithCopy", "h": "outlinedDestroy", "g": "outlinedEnumGetTag", "i": "outlinedEnumTagStore", "j": "outlinedEnumProjectDataForLoad"}
SPECIALIZATIONS = {"g": "genericSpecialization", "G": "genericSpecializationNotReAbstracted", "B": "genericSpecializationInResilienceDomain", "s": "genericSpecializationPrespecialized", "i": "inlinedGenericFunction"}
BUILTINS = {"A": "ImplicitActor", "b": "BridgeObject", "B": "UnsafeValueBuffer", "e": "Executor", "I": "IntLiteral", "O": "UnknownObject", "o": "NativeObject", "p": "RawPointer", "t": "SILToken", "w": "Word", "c": "RawUnsafeContinuation", "D": "DefaultActorStorage", "d": "NonDefaultDistributedActorStorage", "j": "Job", "P": "PackIndex"}
#: Requirement letters: constraint and how its subject is spelt (g generic parameter, a associated type, c compound, s substitution).
REQUIREMENTS = {"V": "value g", "v": "pack g", "c": "base a", "C": "base c", "b": "base g", "B": "base s", "t": "same a", "T": "same c", "s": "same g", "S": "same s", "m": "layout a", "M": "layout c", "l": "layout g", "L": "layout s", "p": "protocol a", "P": "protocol c", "Q": "protocol s", "h": "shape g", "i": "inverse g", "I": "inverse s"}
METATYPES = {"t": "@thin", "T": "@thick", "o": "@objc_metatype"}
IMPL_PARAMS = {"i": "@in", "c": "@in_constant", "l": "@inout", "b": "@inout_aliasable", "n": "@in_guaranteed", "X": "@in_cxx", "x": "@owned", "g": "@guaranteed", "e": "@deallocating", "y": "@unowned", "v": "@pack_owned", "p": "@pack_guaranteed", "m": "@pack_inout"}
IMPL_RESULTS = {"r": "@out", "o": "@owned", "d": "@unowned", "u": "@unowned_inner_pointer", "a": "@autoreleased", "k": "@pack_out", "l": "@guaranteed_address", "g": "@guaranteed", "m": "@inout"}
IMPL_CALLEES = {"y": "@callee_unowned", "g": "@callee_guaranteed", "x": "@callee_owned", "t": "@convention(thin)"}
IMPL_CONVENTIONS = {"B": "block", "C": "c", "M": "method", "O": "objc_method", "K": "closure", "W": "witness_method"}
IMPL_COROUTINES = {"A": "yield_once", "I": "yield_once_2", "G": "yield_many"}
VALUE_WITNESSES = "al ca ta de xx Xx XX CP Cp cp Tk tk pr TK Cc Tt tT xs xg ug up ui et st".split()

#: Fixed values of the format: standard types by letter, kind and name.
STANDARD_TYPES = """
a structure Array | A structure AutoreleasingUnsafeMutablePointer | b structure Bool | c structure UnicodeScalar | D structure Dictionary
d structure Double | f structure Float | h structure Set | I structure DefaultIndices | i structure Int | J structure Character
N structure ClosedRange | n structure Range | O structure ObjectIdentifier | p structure UnsafeMutablePointer | P structure UnsafePointer
R structure UnsafeBufferPointer | r structure UnsafeMutableBufferPointer | S structure String | s structure Substring | u structure UInt
v structure UnsafeMutableRawPointer | V structure UnsafeRawPointer | W structure UnsafeRawBufferPointer | w structure UnsafeMutableRawBufferPointer
q enum Optional | B protocol BinaryFloatingPoint | E protocol Encodable | e protocol Decodable | F protocol FloatingPoint
G protocol RandomNumberGenerator | H protocol Hashable | j protocol Numeric | K protocol BidirectionalCollection
k protocol RandomAccessCollection | L protocol Comparable | l protocol Collection | M protocol MutableCollection
m protocol RangeReplaceableCollection | Q protocol Equatable | T protocol Sequence | t protocol IteratorProtocol | U protocol UnsignedInteger
X protocol RangeExpression | x protocol Strideable | Y protocol RawRepresentable | y protocol StringProtocol | Z protocol SignedInteger
z protocol BinaryInteger
"""
CONCURRENCY_TYPES = """
A protocol Actor | C structure CheckedContinuation | c structure UnsafeContinuation | E structure CancellationError
e structure UnownedSerialExecutor | F protocol Executor | f protocol SerialExecutor | G structure TaskGroup | g structure ThrowingTaskGroup
h protocol TaskExecutor | I protocol AsyncIteratorProtocol | i protocol AsyncSequence | J structure UnownedJob | M class MainActor
P structure TaskPriority | S structure AsyncStream | s structure AsyncThrowingStream | T structure Task | t structure UnsafeCurrentTask
"""
#: Operator characters of letters a to z, blank where a letter has none.
OPERATOR_CHARS = "& @/= >    <*!|+?%-~   ^ ."

DECL_NAMES = set("identifier localDeclName privateDeclName relatedEntityDeclName prefixOperator postfixOperator infixOperator typeSymbolicReference protocolSymbolicReference objectiveCProtocolSymbolicReference".split())
ANY_GENERICS = set("structure class enum protocol protocolSymbolicReference otherNominalType typeAlias typeSymbolicReference objectiveCProtocolSymbolicReference".split())
CONTEXTS = {*ACCESSORS.values(), *(k for k, _ in ENTITIES.values())} | set("anonymousContext autoDiffFunction class curryThunk dispatchThunk enum extension function module opaqueReturnTypeOf otherNominalType protocol protocolSymbolicReference static structure subscript typeSymbolicReference typeAlias variable".split())
ENTITY_KINDS = CONTEXTS | {"type"}
REQUIREMENT_KINDS = set("dependentGenericParamPackMarker dependentGenericParamValueMarker dependentGenericSameTypeRequirement dependentGenericSameShapeRequirement dependentGenericLayoutRequirement dependentGenericConformanceRequirement dependentGenericInverseConformanceRequirement".split())
FUNCTION_ATTRIBUTES = {*SPECIALIZATIONS.values()} | set("functionSignatureSpecialization genericPartialSpecialization genericPartialSpecializationNotReAbstracted objCAttribute nonObjCAttribute dynamicAttribute directMethodReferenceAttribute vTableAttribute partialApplyForwarder partialApplyObjCForwarder outlinedVariable outlinedReadOnlyObject outlinedBridgedMethod mergedFunction distributedThunk distributedAccessor dynamicallyReplaceableFunctionImpl dynamicallyReplaceableFunctionKey dynamicallyReplaceableFunctionVar asyncFunctionPointer asyncAwaitResumePartialFunction asyncSuspendResumePartialFunction accessibleFunctionRecord backDeploymentThunk backDeploymentFallback hasSymbolQuery coroFunctionPointer defaultOverride".split())
MACRO_CONTEXTS = {MACROS[c] for c in "arfmpceq"} | {"macroExpansionLoc"}
PROTOCOLS = {"protocol", "protocolSymbolicReference", "objectiveCProtocolSymbolicReference"}
EXISTENTIALS = {"existentialMetatype", "protocolList", "protocolListWithClass", "protocolListWithAnyObject"}
OPERATORS = {"prefixOperator", "postfixOperator", "infixOperator"}
CONFORMANCES = set("concreteProtocolConformance packProtocolConformance dependentProtocolConformanceRoot dependentProtocolConformanceInherited dependentProtocolConformanceAssociated dependentProtocolConformanceOpaque".split())
SIMPLE_TYPES = set("associatedType associatedTypeRef boundGenericClass boundGenericEnum boundGenericFunction boundGenericOtherNominalType boundGenericProtocol boundGenericStructure boundGenericTypeAlias builtinBorrow builtinTypeName builtinTupleType builtinFixedArray class dependentGenericType dependentMemberType dependentGenericParamType dynamicSelf enum errorType existentialMetatype integer labelList metatype metatypeRepresentation module negativeInteger otherNominalType pack protocol protocolSymbolicReference returnType silBoxType silBoxTypeWithLayout structure sugaredArray sugaredDictionary sugaredOptional sugaredInlineArray sugaredParen tuple tupleElementName typeAlias typeList typeSymbolicReference".split())
#: Marks of a function type that stand before its parameters, in order.
FUNCTION_MARKS = (("sendingResultFunctionType",), ("globalActorFunctionType", "isolatedAnyFunctionType", "nonIsolatedCallerFunctionType"), ("differentiableFunctionType",), ("throwsAnnotation", "typedThrowsAnnotation"), ("concurrentFunctionType",), ("asyncAnnotation",))


def entries(table: str) -> list[list[str]]:
    return [e.split() for line in table.strip().splitlines() for e in line.split("|")]


RULES = {op: (kind.removeprefix("W."), pops, kind.startswith("W.")) for op, kind, pops in entries(REGULAR)}
LEAF_KINDS = dict(entries(LEAVES))
STANDARD = {op: (kind, name) for op, kind, name in entries(STANDARD_TYPES)}
CONCURRENCY = {op: (kind, name) for op, kind, name in entries(CONCURRENCY_TYPES)}
