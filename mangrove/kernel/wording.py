"""Wording of the printer and the list of kinds, as data."""

from __future__ import annotations

#: What stands before the only child that is printed.
PREFIXED = """
anonymousDescriptor | anonymous descriptor |
associatedTypeDescriptor | associated type descriptor for |
asyncRemoved | async demotion of |
canonicalPrespecializedGenericTypeCachingOnceToken | flag for loading of canonical specialized generic type metadata for |
canonicalSpecializedGenericMetaclass | specialized generic metaclass for |
canonicalSpecializedGenericTypeMetadataAccessFunction | canonical specialized generic type metadata accessor for |
classMetadataBaseOffset | class metadata base offset for |
compileTimeLiteral | _const |
coroutineContinuationPrototype | coroutine continuation prototype for |
curryThunk | curry thunk of |
defaultAssociatedTypeMetadataAccessor | default associated type metadata accessor for |
dispatchThunk | dispatch thunk of |
enumCase | enum case for |
extensionDescriptor | extension descriptor |
fullObjCResilientClassStub | full ObjC resilient class stub for |
fullTypeMetadata | full type metadata for |
genericProtocolWitnessTable | generic protocol witness table for |
genericProtocolWitnessTableInstantiationFunction | instantiation function for generic protocol witness table for |
genericTypeMetadataPattern | generic type metadata pattern for |
inOut | inout |
isolated | isolated |
metaclass | metaclass for |
metadataInstantiationCache | metadata instantiation cache for |
methodDescriptor | method descriptor for |
methodLookupFunction | method lookup function for |
moduleDescriptor | module descriptor |
noDerivative | @noDerivative |
nominalTypeDescriptor | nominal type descriptor for |
nominalTypeDescriptorRecord | nominal type descriptor runtime record for |
noncanonicalSpecializedGenericTypeMetadata | noncanonical specialized generic type metadata for |
noncanonicalSpecializedGenericTypeMetadataCache | cache variable for noncanonical specialized generic type metadata for |
objCMetadataUpdateFunction | ObjC metadata update function for |
objCResilientClassStub | ObjC resilient class stub for |
opaqueTypeDescriptor | opaque type descriptor for |
opaqueTypeDescriptorAccessor | opaque type descriptor accessor for |
opaqueTypeDescriptorAccessorImpl | opaque type descriptor accessor impl for |
opaqueTypeDescriptorAccessorKey | opaque type descriptor accessor key for |
opaqueTypeDescriptorAccessorVar | opaque type descriptor accessor var for |
opaqueTypeDescriptorRecord | opaque type descriptor runtime record for |
outlinedAssignWithCopy | outlined assign with copy of |
outlinedAssignWithCopyNoValueWitness | outlined assign with copy of |
outlinedAssignWithTake | outlined assign with take of |
outlinedAssignWithTakeNoValueWitness | outlined assign with take of |
outlinedDestroy | outlined destroy of |
outlinedDestroyNoValueWitness | outlined destroy of |
outlinedEnumGetTag | outlined enum get tag of |
outlinedEnumProjectDataForLoad | outlined enum project data for load of |
outlinedEnumTagStore | outlined enum tag store of |
outlinedInitializeWithCopy | outlined init with copy of |
outlinedInitializeWithCopyNoValueWitness | outlined init with copy of |
outlinedInitializeWithTakeNoValueWitness | outlined init with take of |
outlinedInitializeWithTake | outlined init with take of |
outlinedRelease | outlined release of |
outlinedRetain | outlined retain of |
owned | __owned |
packExpansion | repeat |
propertyDescriptor | property descriptor for |
protocolConformanceDescriptorRecord | protocol conformance descriptor runtime record for |
protocolConformanceDescriptor | protocol conformance descriptor for |
protocolDescriptor | protocol descriptor for |
protocolDescriptorRecord | protocol descriptor runtime record for |
protocolRequirementsBaseDescriptor | protocol requirements base descriptor for |
protocolSelfConformanceDescriptor | protocol self-conformance descriptor for |
protocolSelfConformanceWitness | protocol self-conformance witness for |
protocolSelfConformanceWitnessTable | protocol self-conformance witness table for |
protocolWitnessTable | protocol witness table for |
protocolWitnessTableAccessor | protocol witness table accessor for |
protocolWitnessTablePattern | protocol witness table pattern for |
reflectionMetadataAssocTypeDescriptor | reflection metadata associated type descriptor |
reflectionMetadataBuiltinDescriptor | reflection metadata builtin descriptor |
reflectionMetadataFieldDescriptor | reflection metadata field descriptor |
reflectionMetadataSuperclassDescriptor | reflection metadata superclass descriptor |
resilientProtocolWitnessTable | resilient protocol witness table for |
sending | sending |
shared | __shared |
silBoxType | @box |
silThunkIdentity | identity thunk of |
static | static |
typeMetadata | type metadata for |
typeMetadataAccessFunction | type metadata accessor for |
typeMetadataCompletionFunction | type metadata completion function for |
typeMetadataDemanglingCache | demangling cache variable for type metadata for |
typeMetadataMangledNameRef | mangled name ref for type metadata for |
typeMetadataInstantiationCache | type metadata instantiation cache for |
typeMetadataInstantiationFunction | type metadata instantiation function for |
typeMetadataLazyCache | lazy cache variable for type metadata for |
typeMetadataSingletonInitializationCache | type metadata singleton initialization cache for |
uniquable | uniquable |
valueWitnessTable | value witness table for |
constValue | @const |
"""
#: Text of kinds that print nothing else.
WORDS = """
asyncAnnotation |  async|
asyncFunctionPointer | async function pointer to |
builtinTupleType | Builtin.TheTupleType|
concurrentFunctionType | @Sendable |
constrainedExistentialSelf | Self|
directMethodReferenceAttribute | super |
dynamicAttribute | dynamic |
dynamicSelf | Self|
emptyList |  empty-list |
errorType | <ERROR TYPE>|
firstElementMarker |  first-element-marker |
hasSymbolQuery | #_hasSymbol query for |
implEscaping | @escaping|
implErasedIsolation | @isolated(any)|
implSendingResult | sending|
isolatedAnyFunctionType | @isolated(any) |
nonIsolatedCallerFunctionType | nonisolated(nonsending) |
isSerialized | serialized|
nonObjCAttribute | @nonobjc |
objCAttribute | @objc |
opaqueReturnType | some|
representationChanged | representation changed|
sendingResultFunctionType | sending |
throwsAnnotation |  throws|
unknownIndex | unknown index|
variadicMarker |  variadic-marker |
vTableAttribute | override |
coroFunctionPointer | coro function pointer to |
defaultOverride | default override of |
"""
#: Text that short thunks leave out.
THUNK_WORDS = """
accessibleFunctionRecord | accessible function runtime record for |
backDeploymentThunk | back deployment thunk for |
backDeploymentFallback | back deployment fallback for |
distributedAccessor | distributed accessor for |
distributedThunk | distributed thunk |
dynamicallyReplaceableFunctionImpl | dynamically replaceable thunk for |
dynamicallyReplaceableFunctionKey | dynamically replaceable key for |
dynamicallyReplaceableFunctionVar | dynamically replaceable variable for |
"""
#: Accessors of variables and subscripts.
STORAGE = """
borrowAccessor | borrow|
didSet | didset|
getter | getter|
globalGetter | getter|
initAccessor | init|
materializeForSet | materializeForSet|
modifyAccessor | modify|
modify2Accessor | modify2|
mutateAccessor | mutate|
nativeOwningAddressor | nativeOwningAddressor|
nativeOwningMutableAddressor | nativeOwningMutableAddressor|
nativePinningAddressor | nativePinningAddressor|
nativePinningMutableAddressor | nativePinningMutableAddressor|
owningAddressor | owningAddressor|
owningMutableAddressor | owningMutableAddressor|
readAccessor | read|
read2Accessor | read2|
setter | setter|
unsafeAddressor | unsafeAddressor|
unsafeMutableAddressor | unsafeMutableAddressor|
willSet | willset|
"""
#: Macro roles.
MACRO_WORDS = """
accessorAttachedMacroExpansion | accessor|
bodyAttachedMacroExpansion | body|
conformanceAttachedMacroExpansion | conformance|
extensionAttachedMacroExpansion | extension|
preambleAttachedMacroExpansion | preamble|
memberAttachedMacroExpansion | member|
memberAttributeAttachedMacroExpansion | memberAttribute|
peerAttachedMacroExpansion | peer|
"""
#: All kinds by class.
KINDS = {
    "entity": "allocator borrowAccessor constructor curryThunk deallocator defaultArgumentInitializer destructor didSet enumCase explicitClosure function genericTypeParamDecl getter globalGetter implicitClosure initAccessor initializer isolatedDeallocator iVarDestroyer iVarInitializer macro materializeForSet modifyAccessor modify2Accessor mutateAccessor nativeOwningAddressor nativeOwningMutableAddressor nativePinningAddressor nativePinningMutableAddressor owningAddressor owningMutableAddressor propertyWrapperBackingInitializer propertyWrapperInitFromProjectedValue propertyWrappedFieldInitAccessor readAccessor read2Accessor setter static subscript unsafeAddressor unsafeMutableAddressor variable willSet",
    "metadata": "accessibleFunctionRecord anonymousDescriptor associatedConformanceDescriptor associatedTypeDescriptor associatedTypeMetadataAccessor baseConformanceDescriptor canonicalSpecializedGenericMetaclass canonicalSpecializedGenericTypeMetadataAccessFunction classMetadataBaseOffset defaultAssociatedTypeMetadataAccessor extensionDescriptor fullObjCResilientClassStub fullTypeMetadata genericTypeMetadataPattern metaclass metadataInstantiationCache methodDescriptor moduleDescriptor nominalTypeDescriptor nominalTypeDescriptorRecord noncanonicalSpecializedGenericTypeMetadata noncanonicalSpecializedGenericTypeMetadataCache objCMetadataUpdateFunction objCResilientClassStub opaqueTypeDescriptor opaqueTypeDescriptorAccessor opaqueTypeDescriptorAccessorImpl opaqueTypeDescriptorAccessorKey opaqueTypeDescriptorAccessorVar opaqueTypeDescriptorRecord opaqueTypeDescriptorSymbolicReference propertyDescriptor protocolConformanceDescriptorRecord protocolConformanceDescriptor protocolDescriptor protocolDescriptorRecord protocolRequirementsBaseDescriptor protocolSelfConformanceDescriptor reflectionMetadataAssocTypeDescriptor reflectionMetadataBuiltinDescriptor reflectionMetadataFieldDescriptor reflectionMetadataSuperclassDescriptor typeMetadata typeMetadataAccessFunction typeMetadataCompletionFunction typeMetadataDemanglingCache typeMetadataMangledNameRef typeMetadataInstantiationCache typeMetadataInstantiationFunction typeMetadataLazyCache typeMetadataSingletonInitializationCache",
    "symref": "accessorFunctionReference nonUniqueExtendedExistentialTypeShapeSymbolicReference objectiveCProtocolSymbolicReference protocolSymbolicReference symbolicExtendedExistentialType typeSymbolicReference uniqueExtendedExistentialTypeShapeSymbolicReference",
    "macro": "accessorAttachedMacroExpansion bodyAttachedMacroExpansion conformanceAttachedMacroExpansion extensionAttachedMacroExpansion preambleAttachedMacroExpansion freestandingMacroExpansion macroExpansionLoc macroExpansionUniqueName memberAttachedMacroExpansion memberAttributeAttachedMacroExpansion peerAttachedMacroExpansion",
    "name/context": "anonymousContext declContext extension identifier infixOperator localDeclName module postfixOperator prefixOperator privateDeclName relatedEntityDeclName",
    "conformance": "anyProtocolConformanceList concreteProtocolConformance defaultAssociatedConformanceAccessor packProtocolConformance protocolConformance protocolConformanceRefInTypeModule protocolConformanceRefInProtocolModule protocolConformanceRefInOtherModule protocolSelfConformanceWitness protocolSelfConformanceWitnessTable retroactiveConformance",
    "type": "argumentTuple associatedType associatedTypeRef autoClosureType boundGenericClass boundGenericEnum boundGenericFunction boundGenericOtherNominalType boundGenericProtocol boundGenericStructure boundGenericTypeAlias builtinBorrow builtinTypeName builtinTupleType builtinFixedArray cFunctionPointer clangType class compileTimeLiteral concurrentFunctionType coroutineContinuationPrototype dynamicSelf enum errorType escapingAutoClosureType escapingObjCBlock existentialMetatype functionType globalActorFunctionType inOut integer isolated isolatedAnyFunctionType nonIsolatedCallerFunctionType metatype metatypeRepresentation negativeInteger noEscapeFunctionType objCBlock otherNominalType owned pack packElement packElementLevel packExpansion protocol protocolList protocolListWithAnyObject protocolListWithClass returnType sending sendingResultFunctionType shared structure sugaredOptional sugaredArray sugaredDictionary sugaredParen sugaredInlineArray thinFunctionType tuple tupleElement tupleElementName type typeAlias typeList uncurriedFunctionType unmanaged unowned weak constValue",
    "marker/attr": "associatedTypeGenericParamRef assocTypePath asyncAnnotation asyncAwaitResumePartialFunction asyncFunctionPointer asyncSuspendResumePartialFunction backDeploymentFallback canonicalPrespecializedGenericTypeCachingOnceToken checkedObjCAsyncCompletionHandlerImpl directMethodReferenceAttribute directness distributedAccessor dynamicallyReplaceableFunctionImpl dynamicallyReplaceableFunctionKey dynamicallyReplaceableFunctionVar dynamicAttribute emptyList extendedExistentialTypeShape fieldOffset firstElementMarker global globalVariableOnceDeclList globalVariableOnceToken globalVariableOnceFunction hasSymbolQuery index labelList mergedFunction methodLookupFunction nonObjCAttribute number objCAttribute objCAsyncCompletionHandlerImpl suffix throwsAnnotation typedThrowsAnnotation typeMangling uniquable unknownIndex variadicMarker vTableAttribute coroFunctionPointer defaultOverride",
    "thunk/witness": "associatedTypeWitnessTableAccessor backDeploymentThunk baseWitnessTableAccessor dispatchThunk distributedThunk genericProtocolWitnessTable genericProtocolWitnessTableInstantiationFunction keyPathEqualsThunkHelper keyPathGetterThunkHelper keyPathHashThunkHelper keyPathSetterThunkHelper keyPathAppliedMethodThunkHelper keyPathUnappliedMethodThunkHelper lazyProtocolWitnessTableAccessor lazyProtocolWitnessTableCacheVariable partialApplyForwarder partialApplyObjCForwarder protocolWitness protocolWitnessTable protocolWitnessTableAccessor protocolWitnessTablePattern reabstractionThunk reabstractionThunkHelper reabstractionThunkHelperWithGlobalActor reabstractionThunkHelperWithSelf resilientProtocolWitnessTable silThunkIdentity valueWitness valueWitnessTable vTableThunk",
    "specialization": "asyncRemoved droppedArgument functionSignatureSpecialization functionSignatureSpecializationParam functionSignatureSpecializationReturn functionSignatureSpecializationParamKind functionSignatureSpecializationParamPayload genericPartialSpecialization genericPartialSpecializationNotReAbstracted genericSpecialization genericSpecializationInResilienceDomain genericSpecializationPrespecialized genericSpecializationNotReAbstracted genericSpecializationParam inlinedGenericFunction isSerialized representationChanged specializationPassID",
    "autodiff": "autoDiffDerivativeVTableThunk autoDiffFunction autoDiffFunctionKind autoDiffSelfReorderingReabstractionThunk autoDiffSubsetParametersThunk differentiabilityWitness differentiableFunctionType implDifferentiabilityKind implParameterResultDifferentiability indexSubset noDerivative",
    "generics": "constrainedExistential constrainedExistentialRequirementList constrainedExistentialSelf dependentAssociatedConformance dependentAssociatedTypeRef dependentGenericConformanceRequirement dependentGenericInverseConformanceRequirement dependentGenericLayoutRequirement dependentGenericParamCount dependentGenericParamPackMarker dependentGenericParamValueMarker dependentGenericParamType dependentGenericSameShapeRequirement dependentGenericSameTypeRequirement dependentGenericSignature dependentGenericType dependentMemberType dependentProtocolConformanceAssociated dependentProtocolConformanceInherited dependentProtocolConformanceRoot dependentProtocolConformanceOpaque dependentPseudogenericSignature",
    "sil-fn": "implConvention implErrorResult implEscaping implErasedIsolation implSendingResult implParameterSending implParameterIsolated implParameterImplicitLeading implFunctionAttribute implFunctionConvention implFunctionConventionName implFunctionType implCoroutineKind implInvocationSubstitutions implParameter implPatternSubstitutions implResult implYield",
    "opaque": "opaqueReturnType opaqueReturnTypeIndex opaqueReturnTypeOf opaqueReturnTypeParent opaqueType",
    "outlined": "outlinedAssignWithCopy outlinedAssignWithCopyNoValueWitness outlinedAssignWithTake outlinedAssignWithTakeNoValueWitness outlinedBridgedMethod outlinedConsume outlinedCopy outlinedDestroy outlinedDestroyNoValueWitness outlinedEnumGetTag outlinedEnumProjectDataForLoad outlinedEnumTagStore outlinedInitializeWithCopy outlinedInitializeWithCopyNoValueWitness outlinedInitializeWithTakeNoValueWitness outlinedInitializeWithTake outlinedRelease outlinedRetain outlinedVariable outlinedReadOnlyObject",
    "sil-type": "silBoxImmutableField silBoxLayout silBoxMutableField silBoxType silBoxTypeWithLayout silPackDirect silPackIndirect",
}


def lines(table: str) -> dict[str, str]:
    """Kind to text; the text keeps its spaces up to the closing bar."""
    return {kind: text.rstrip("\n")[:-1] for kind, _, text in (line.partition(" | ") for line in table.strip().splitlines())}


def classes() -> dict[str, str]:
    return {kind: name for name, kinds in KINDS.items() for kind in kinds.split()}
