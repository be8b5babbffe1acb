"""Estimators, variances, calibration and panel operators."""
