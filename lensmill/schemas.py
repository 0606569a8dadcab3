"""Schemas of the library's tables."""

MEDIA = "filePath string, fileName string, mediaType string, capturedAtMs long, modifiedAtMs long, indexedAtMs long, parentPath string, fileSize long, isFavorite boolean, isTrashed boolean, width int, height int, mimeType string, durationMs long, latitude double, longitude double, make string, model string, aperture string, focalLength string, iso string, exposureTime string, orientation int, sceneType string, thumbnailPath string, fingerprintHead string, perceptualHash long, ocrText string, qualityScore float, deletedAtMs long, isCorrupted boolean, faceClusterId string, scanGeneration long"
FACES = "faceId long, filePath string, clusterId string, personName string, embedding array<float>, box struct<left: float, top: float, right: float, bottom: float>, thumbnailPath string, detectedAtMs long"
PROTOTYPES = "generation long, clusterId string, prototypeIndex int, embedding array<float>, sampleCount long, providerScope string, modelScope string"
EMBEDDINGS = "filePath string, embedding array<float>, modelVersion int, providerId string, modelId string, dimension int, spaceId string, generation long"
TASKS = "taskId long, filePath string, sourceVersion string, pipelineScope string, priority int, status string, attemptCount int, nextRetryAt long, leaseUntil long, leaseToken string, createdAt long"
CACHE = "filePath string, sizeClass string, sourceVersion string, byteSize long, lastAccessAt long, state string, leaseUntil long"
TOMBSTONES = "pathKey string, filePath string, operation string, state string, attemptCount int, nextRetryAt long, leaseUntil long, leaseToken string, deletedAtMs long"
SCAN_STAGING = "scanId string, filePath string, sourceMask int, mediaStoreJson string, fileSystemJson string"
RUNS = "taskType string, generation long, status string, cursorPath string, scannedCount long, eligibleCount long, failedCount long, isActive boolean"
FEATURES = "filePath string, pluginId string, featureType string, dataJson string, schemaJson string, modelVersion int"
ANALYSIS_STATE = "filePath string, stageId string, status string, modelVersion int"
