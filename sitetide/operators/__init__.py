"""sitetide.operators"""
