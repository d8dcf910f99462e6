"""sitetide.sources"""
