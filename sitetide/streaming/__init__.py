"""sitetide.streaming"""
